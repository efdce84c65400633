"""Row-preserving trial flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions.columns import flag, quantile, require_columns

REQUIRED = ["observation_id", "dataset_id", "participant_id", "block_raw", "correct", "rt_ms"]
#: Text that marks a documented missing response, in any of these optional columns.
NONRESPONSE_COLUMNS = ("documented_nonresponse_raw", "timeout", "no_response")
NONRESPONSE_VALUES = ("1", "true", "yes", "timeout")


def flag_trials(trials: DataFrame, *, rt_min: float = 150.0, rt_max: float = 3000.0, mad_multiplier: float = 3.0, fast_error_below: float = 250.0) -> DataFrame:
    """Adds flags and robust limits of the participant; every row stays. One exchange serves both participant windows."""
    require_columns(trials, REQUIRED)
    rt = F.col("rt_ms")
    w = Window.partitionBy("dataset_id", "participant_id")
    out = trials.withColumns({
        "rt_missing": rt.isNull(),
        "practice_block": flag(F.col("block_raw") < 0),
        "rt_below_min": flag(rt < rt_min),
        "rt_above_max": flag(rt > rt_max),
        "participant_rt_median_ms": F.median(rt).over(w),
    })
    distance = F.abs(rt - F.col("participant_rt_median_ms"))
    out = out.withColumn("participant_rt_mad_ms", F.median(distance).over(w))
    mad = F.col("participant_rt_mad_ms")
    out = out.withColumn("rt_robust_outlier", flag((mad > 0) & (distance > mad_multiplier * mad)))
    out = out.withColumn("rt_excluded", F.col("rt_missing") | F.col("rt_below_min") | F.col("rt_above_max") | F.col("rt_robust_outlier"))
    out = out.withColumns({"documented_nonresponse": documented_nonresponse(out), "valid_rt": ~F.col("rt_excluded")})
    out = out.withColumns({
        "lapse_proxy": F.col("rt_missing") | F.col("documented_nonresponse"),
        "participant_rt_q90_ms": quantile(F.when(F.col("valid_rt"), rt), 0.9).over(w),
    })
    return out.withColumns({
        "slow_tail_sensitivity": flag(F.col("valid_rt") & (rt > F.col("participant_rt_q90_ms"))),
        "fast_error": flag(F.col("valid_rt") & (F.col("correct") == 0) & (rt < fast_error_below)),
        "valid_correct_rt": flag(F.col("valid_rt") & (F.col("correct") == 1)),
        "analysis_eligible_trial": ~F.col("practice_block"),
    })


def documented_nonresponse(df: DataFrame):
    found = F.lit(False)
    for c in NONRESPONSE_COLUMNS:
        if c in df.columns:
            found = found | flag(F.lower(F.col(c).cast("string")).isin(*NONRESPONSE_VALUES))
    return found
