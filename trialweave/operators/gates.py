"""Quality gates with their reasons, and reports of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def task_gate(windows: DataFrame, features: list[str], *, windows_least: int = 300, datasets_least: int = 3, features_least: int = 5, complete_least: float = 0.8) -> DataFrame:
    """task_family, counts, complete fraction, passed and the reasons why not."""
    complete = F.lit(True)
    for c in features:
        complete = complete & F.col(c).isNotNull()
    usable = sum((F.when(F.avg(F.col(c).isNotNull().cast("int")) >= complete_least, 1).otherwise(0) for c in features), F.lit(0))
    g = windows.groupBy("task_family").agg(F.count("*").alias("windows"), F.count_distinct("dataset_id").alias("datasets"), usable.alias("features"), F.avg(complete.cast("int")).alias("complete_fraction"))
    reasons = F.array_compact(F.array(
        F.when(F.col("windows") < windows_least, "too_few_windows"), F.when(F.col("datasets") < datasets_least, "too_few_datasets"), F.when(F.col("features") < features_least, "too_few_features"),
        F.when(F.col("complete_fraction") < complete_least, "too_incomplete")))
    return g.withColumn("reasons", F.concat_ws("; ", reasons)).withColumn("passed", F.col("reasons") == "")


def modelling_plan(gates: DataFrame) -> DataFrame:
    """Tasks that may be modelled; pooled models only from two of them on."""
    n = gates.agg(F.count_if("passed").alias("n"))
    return gates.join(n, F.lit(True)).select("task_family", F.when(F.col("passed"), "model").otherwise("skip").alias("action"), (F.col("n") >= 2).alias("pooled_allowed"))


def preflight(windows: DataFrame, feature: str, *, availability: float = 0.2, dominance: float = 0.8) -> DataFrame:
    """Whether a feature is available and not from one source only, by task."""
    by = windows.groupBy("task_family", "dataset_id").agg(F.count(feature).alias("k"), F.count("*").alias("n"))
    g = by.groupBy("task_family").agg((F.sum("k") / F.sum("n")).alias("available"), (F.max("k") / F.nullif(F.sum("k").cast("double"), F.lit(0.0))).alias("largest_source"))
    verdict = F.when(F.col("available") <= availability, "structurally_unavailable").when(F.col("largest_source") >= dominance, "one_source_dominates").otherwise("ok")
    return g.withColumn("verdict", verdict)


def completeness(recordings: DataFrame, participant: str, expected: int) -> DataFrame:
    """Participants with exactly the expected recordings and no error."""
    g = recordings.groupBy(participant).agg(F.count("*").alias("recordings"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    return g.withColumn("complete", (F.col("recordings") == expected) & (F.col("errors") == 0))


def markdown(title: str, df: DataFrame) -> str:
    """A report table with all rows, one partition after another."""
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in df.toLocalIterator()]
    return "\n".join(lines) + "\n"
