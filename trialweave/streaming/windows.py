"""Count and time windows over a stream of trials."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_count_windows(trials: DataFrame, keys: list[str], size: int, value: str = "rt_ms") -> DataFrame:
    """Full windows of ``size`` rows in order of arrival within a key: the key, window_index, n, mean.

    The state of a key is its open window: an index, a count and a sum.
    """
    kinds = {c: trials.schema[c].dataType.simpleString() for c in keys}
    out = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", window_index long, n long, mean double"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        index, n, total, seen = state.get if state.exists else (0, 0, 0.0, 0)
        done = []
        for pdf in batches:
            for v in pdf[value]:
                n += 1
                if pd.notna(v):
                    total, seen = total + float(v), seen + 1
                if n == size:
                    done.append((*key, index, n, total / seen if seen else None))
                    index, n, total, seen = index + 1, 0, 0.0, 0
        state.update((index, n, total, seen))
        yield pd.DataFrame(done, columns=[*keys, "window_index", "n", "mean"])

    return trials.groupBy(*keys).applyInPandasWithState(step, out, "i long, n long, total double, seen long", "append", "NoTimeout")


def stream_time_windows(events: DataFrame, keys: list[str], time: str, width: str, late: str, value: str) -> DataFrame:
    """Means over time windows with a watermark for late rows."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return rows.select(F.col("window.start").alias("start"), *keys, "n", "mean")
