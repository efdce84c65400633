"""Count windows inside a boundary, time windows inside a block, and links between neighbouring windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions.columns import quantile, row_rms, spread_z, with_spreads
from trialweave.plans.staging import staged
from trialweave.sources.tables import BOUNDARY

PRIMARY, SENSITIVITY, REMAINDER = 16, (12, 24), 8


def trial_windows(trials: DataFrame, *, primary: int = PRIMARY, sensitivity: tuple[int, ...] = SENSITIVITY, remainder: int = REMAINDER, boundary: list[str] | None = None) -> DataFrame:
    """Tumbling count windows of each size in order of (trial_raw, observation_id), nulls last.

    Full windows are ``full``; what is left of the primary size, from ``remainder`` rows on, is one ``aggregate_remainder``, not fit
    for dynamics.  The rows are numbered once; sizes are exploded after the window function, so there is one exchange.
    """
    keys = boundary or BOUNDARY
    w = Window.partitionBy(*keys)
    order = w.orderBy(F.asc_nulls_last("trial_raw"), F.asc_nulls_last("observation_id"))
    rows = trials.withColumns({"__rn": F.row_number().over(order) - 1, "__n": F.count(F.lit(1)).over(w)})
    sizes = F.explode(F.array(*[F.lit(s) for s in (primary, *sensitivity)]))
    rows = rows.withColumn("window_size", sizes)
    rows = rows.withColumn("window_index", F.floor(F.col("__rn") / F.col("window_size")))
    full = F.col("window_index") < F.floor(F.col("__n") / F.col("window_size"))
    rest = ~full & (F.col("window_size") == primary) & (F.col("__n") % primary >= remainder)
    rows = rows.filter(full | rest).withColumn("window_kind", F.when(full, "full").otherwise("aggregate_remainder"))
    length = F.when(F.col("window_kind") == "full", F.col("window_size")).otherwise(F.col("__n") % primary)
    rows = rows.withColumns({
        "position": (F.col("__rn") % F.col("window_size")).cast("long"),
        "dynamics_eligible": F.col("window_kind") == "full",
        "window_id": F.concat_ws(":", F.coalesce("task_family", F.lit("")), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys if c != "task_family"], "window_size", "window_index", "window_kind"),
    })
    return rows.withColumn("fraction", F.col("position") / F.greatest(length - 1, F.lit(1))).drop("__rn", "__n")


def prefix_windows(members: DataFrame, counts: tuple[int, ...]) -> DataFrame:
    """The first k rows of each full window, for each k; the id ends with ``:prefix:k``."""
    rows = members.filter("window_kind = 'full'").withColumn("prefix", F.explode(F.array(*[F.lit(k) for k in counts])))
    rows = rows.filter((F.col("position") < F.col("prefix")) & (F.col("prefix") <= F.col("window_size")))
    return rows.withColumn("window_id", F.concat_ws(":", "window_id", F.lit("prefix"), "prefix"))


def interval_windows(blocks: DataFrame, duration: str, seconds: float | None) -> DataFrame:
    """Whole windows of ``seconds`` in [0, duration), or one full window where it is None: window_index, start_s, stop_s."""
    if seconds is None:
        return blocks.select("*", F.lit(0).cast("long").alias("window_index"), F.lit(0.0).alias("start_s"), F.col(duration).cast("double").alias("stop_s"))
    n = F.floor(F.col(duration) / seconds).cast("long")
    rows = blocks.withColumn("window_index", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))))
    return rows.withColumns({"start_s": F.col("window_index") * F.lit(float(seconds)), "stop_s": (F.col("window_index") + 1) * F.lit(float(seconds))})


def rr_windows(rr: DataFrame, seconds: float, maximum: int | None = None) -> DataFrame:
    """Interval rows in windows of cumulated time; a row belongs where its end falls in (start, stop]; only whole windows.

    With ``maximum``, that many windows, evenly spaced.
    """
    length = 1000.0 * seconds
    good = rr.filter("rr_ms > 0 and not isnan(rr_ms)")
    w = Window.partitionBy("participant_id")
    run = w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = good.withColumns({"end_ms": F.sum("rr_ms").over(run), "total_ms": F.sum("rr_ms").over(w)})
    rows = rows.withColumn("window_index", (F.ceil(F.col("end_ms") / length) - 1).cast("long"))
    whole = F.floor(F.col("total_ms") / length)
    rows = rows.filter(F.col("window_index") < whole)
    if maximum is not None:
        rows = rows.filter(spaced(F.col("window_index"), whole, maximum))
    return rows


def spaced(index, n, maximum: int):
    """Whether an index of 0..n-1 is one of ``maximum`` evenly spaced ones, int(linspace(0, n - 1, maximum))."""
    if maximum == 1:
        return index == 0
    step = (n - 1) / F.lit(float(maximum - 1))
    picks = F.transform(F.sequence(F.lit(0), F.lit(maximum - 1)), lambda i: F.when(i == maximum - 1, n - 1).otherwise(F.floor(i * step)))
    return (n <= maximum) | F.array_contains(picks.cast("array<bigint>"), index.cast("long"))


def transitions(windows: DataFrame, *, keys: list[str] | None = None, large: float = 0.9, least: int = 3) -> DataFrame:
    """Deltas to the previous and outcomes of the next window, only where the neighbour's index is next to this one's."""
    keys = keys or [*BOUNDARY, "window_size"]
    w = Window.partitionBy(*keys).orderBy("window_index")
    before = F.coalesce(F.lag("window_index").over(w) == F.col("window_index") - 1, F.lit(False))
    after = F.coalesce(F.lead("window_index").over(w) == F.col("window_index") + 1, F.lit(False))
    deltas = {"delta_throughput": "throughput_proxy", "delta_accuracy": "accuracy", "delta_rt_cv": "rt_cv", "delta_interference_rt_cost": "control_cost_rt_ms"}
    nexts = {"next_accuracy": "accuracy", "next_throughput": "throughput_proxy", "next_rt_cv": "rt_cv", "next_error_burstiness": "error_burstiness"}
    out = windows.withColumns({
        "has_previous_window": before, "has_next_window": after, "next_window_id": F.when(after, F.lead("window_id").over(w)),
        **{d: F.when(before, F.col(s) - F.lag(s).over(w)) for d, s in deltas.items()}, **{d: F.when(after, F.lead(s).over(w)) for d, s in nexts.items()},
    })
    reason = {f"missing_reason_{d}": F.when(~F.col("has_previous_window"), "no_previous_window").when(F.col(d).isNull(), "source_metric_unavailable") for d in deltas}
    reason |= {f"missing_reason_{d}": F.when(~F.col("has_next_window"), "no_next_window").when(F.col(d).isNull(), "next_metric_unavailable") for d in nexts}
    out = out.withColumns({**reason, **{d.replace("next_", "change_"): F.col(d) - F.col(s) for d, s in nexts.items()}})
    # Scales of a source and its limit are aggregates, joined back; the rows they are read from are written once.
    source = ["dataset_id", "task_family", "window_size"]
    out = staged(out, "transitions")
    out = with_spreads(out, source, list(deltas)).withColumns({f"{d}_z": spread_z(d) for d in deltas})
    out = out.withColumn("combined_update_magnitude", row_rms([F.col(f"{d}_z") for d in deltas], least)).drop(*[f"__{x}_{d}" for d in deltas for x in ("q", "sd")])
    limit = out.groupBy(*[F.col(k).alias(f"__k_{k}") for k in source]).agg(quantile(F.col("combined_update_magnitude"), large).alias("__limit"))
    on = F.lit(True)
    for k in source:
        on &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    out = out.join(limit, on, "left")
    return out.withColumn("large_update_window", (F.col("combined_update_magnitude") >= F.col("__limit")).cast("int")).drop("__limit", *[f"__k_{k}" for k in source])
