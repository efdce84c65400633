"""Window summaries: one row a window from its trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions.columns import count_where, mean_where, safe_div, slope

IDS = ["window_id", "dataset_id", "participant_id", "task_family", "block_raw", "window_size", "window_index", "window_kind", "dynamics_eligible"]


def window_summary(members: DataFrame, *, series: str = "rt_ms", condition_trials: int = 3, post_error: int = 1, post_correct: int = 3, keys: list[str] | None = None) -> DataFrame:
    """Accuracy, speed, variability, control costs, post-error slowing, burstiness, drift and volatility of each window.

    One window function over (window, position) and one aggregation by the same key.
    """
    w = Window.partitionBy("window_id").orderBy("position")
    rows = members.withColumns({"__before": F.lag("correct").over(w), "__step": F.abs(F.col(series) - F.lag(series).over(w))})
    rt, correct = F.col("rt_ms"), F.col("correct").cast("double")
    valid = F.col("valid_correct_rt")
    crt = F.when(valid, rt)
    con, inc = F.col("congruency") == "congruent", F.col("congruency") == "incongruent"
    cells = {"n_con_rt": valid & con & rt.isNotNull(), "n_inc_rt": valid & inc & rt.isNotNull(), "n_con_acc": con & correct.isNotNull(), "n_inc_acc": inc & correct.isNotNull()}
    after_error, after_correct = valid & (F.col("__before") == 0) & rt.isNotNull(), valid & (F.col("__before") == 1) & rt.isNotNull()
    error = F.coalesce(F.col("correct") == 0, F.lit(False))
    out = rows.groupBy(*(keys or IDS)).agg(
        F.count("*").alias("n_trials"),
        count_where(F.col("valid_rt")).alias("n_valid_rt"),
        count_where(valid).alias("n_valid_correct_rt"),
        F.avg(correct).alias("accuracy"),
        F.median(crt).alias("median_rt_ms"),
        F.avg(crt).alias("mean_rt_ms"),
        F.stddev_samp(crt).alias("sd_rt_ms"),
        F.avg(F.col("lapse_proxy").cast("double")).alias("nonresponse_rate"),
        F.avg(F.col("slow_tail_sensitivity").cast("double")).alias("slow_tail_rate"),
        F.avg(F.col("fast_error").cast("double")).alias("fast_error_rate"),
        F.avg(F.col("rt_excluded").cast("double")).alias("rt_excluded_fraction"),
        F.avg("__step").alias("rt_volatility"),
        slope(F.col(series), F.col("position").cast("double")).alias("rt_drift"),
        slope(1 - correct, F.col("position").cast("double")).alias("error_drift"),
        *[count_where(c).alias(n) for n, c in cells.items()],
        mean_where(rt, cells["n_con_rt"]).alias("con_rt"), mean_where(rt, cells["n_inc_rt"]).alias("inc_rt"),
        mean_where(correct, con).alias("con_acc"), mean_where(correct, inc).alias("inc_acc"),
        count_where(after_error).alias("pes_post_error_n"), count_where(after_correct).alias("pes_post_correct_n"),
        mean_where(rt, after_error).alias("post_error_rt"), mean_where(rt, after_correct).alias("post_correct_rt"),
        F.sum(error.cast("int")).alias("n_errors"), count_where(error & (F.col("__before") == 0)).alias("error_pairs"),
    )
    costs = F.least(*cells) >= condition_trials
    pes = (F.col("pes_post_error_n") >= post_error) & (F.col("pes_post_correct_n") >= post_correct)
    rate = F.col("n_errors") / F.col("n_trials")
    expected = (F.col("n_trials") - 1) * rate * rate
    return out.withColumns({
        "rt_cv": F.when(F.col("mean_rt_ms") > 0, F.col("sd_rt_ms") / F.col("mean_rt_ms")),
        "throughput_proxy": F.when(F.col("median_rt_ms") > 0, F.col("accuracy") / (F.col("median_rt_ms") / 1000)),
        "control_cost_supported": costs,
        "control_cost_rt_ms": F.when(costs, F.col("inc_rt") - F.col("con_rt")),
        "control_cost_acc": F.when(costs, F.col("con_acc") - F.col("inc_acc")),
        "pes_supported": pes,
        "post_error_slowing_ms": F.when(pes, F.col("post_error_rt") - F.col("post_correct_rt")),
        "error_burstiness": F.when(F.col("n_trials") >= 2, F.when(F.col("n_errors") == 0, 0.0).otherwise(safe_div(F.col("error_pairs"), expected))),
    })
