"""Joins with contracts, range and as-of joins, matching."""

from __future__ import annotations

import itertools
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows; an error if a key is there twice (a null is a key)."""
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"duplicate keys in {keys}")
    return df


def validated_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """An equi join whose cardinality is checked first: one_to_one, many_to_one, one_to_many."""
    if validate not in ("one_to_one", "many_to_one", "one_to_many"):
        raise ValueError(f"unknown contract {validate}")
    if validate.startswith("one"):
        assert_unique(left, on)
    if validate.endswith("one"):
        assert_unique(right, on)
    return left.join(right, on, how)


def unambiguous(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is there once."""
    return df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("__n = 1").drop("__n")


def window_containment(events: DataFrame, time: str, width: float) -> DataFrame:
    """Events with the index of their window [k * width, (k + 1) * width): an equi key instead of a range join."""
    return events.withColumn("window_index", F.floor(F.col(time) / width))


def forward_responses(events: DataFrame, keys: list[str], order: list[str], stimulus: Column, response: Column, stop: Column) -> DataFrame:
    """Each stimulus with the first later response before the next stimulus or stop.

    A running count of stimuli cuts the stream into segments, so the as-of join is one window and one aggregation.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = events.withColumn("__segment", F.sum(stimulus.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("__segment > 0")
    at = F.struct(*order)
    return rows.groupBy(*keys, "__segment").agg(
        F.min(F.when(stimulus, at)).alias("stimulus"), F.min(F.when(response, at)).alias("first_response"), F.min(F.when(stop, at)).alias("first_stop")
    ).select(*keys, "stimulus", F.when(F.col("first_stop").isNull() | (F.col("first_response") < F.col("first_stop")), F.col("first_response")).alias("response"))


def band_matches(a: np.ndarray, b: np.ndarray, tolerance: float) -> int:
    """How many of two sorted arrays pair up one to one within the tolerance, the earliest first."""
    i = j = n = 0
    while i < len(a) and j < len(b):
        gap = a[i] - b[j]
        if abs(gap) <= tolerance:
            n, i, j = n + 1, i + 1, j + 1
        elif gap < 0:
            i += 1
        else:
            j += 1
    return n


def matched_points(points: DataFrame, keys: list[str], tolerance: float, parts: int | None = None) -> DataFrame:
    """keys, t0, t1: the pairs of :func:`band_matches` of points (keys, side 0 or 1, t).

    A match never reaches over a gap wider than the tolerance, so the runs between such gaps are dealt to tasks and read in order: a task holds the points within one tolerance.  ``parts`` is the number of tasks, if not Spark's own.
    """
    w = Window.partitionBy(*keys).orderBy("t", "side")
    gap = F.coalesce((F.col("t") - F.lag("t").over(w) > tolerance).cast("long"), F.lit(0))
    runs = points.select(*keys, "side", "t").withColumn("gap", gap).withColumn("run", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = [*keys, "run"]
    dealt = runs.select(*at, "t", "side").repartition(*([parts] if parts else []), *at).sortWithinPartitions(*keys, "run", "t", "side")

    def match(frames):
        here, waiting = None, (deque(), deque())
        for pdf in frames:
            out = []
            rows = zip(*(pdf[c].tolist() for c in (*keys, "run", "t", "side")), strict=True)
            for *run, t, side in rows:
                if run != here:
                    here, waiting = run, (deque(), deque())
                other = waiting[1 - side]
                while other and t - other[0] > tolerance:
                    other.popleft()
                if other:
                    pair = (other.popleft(), t)
                    out.append((*run[:-1], *(pair if side else pair[::-1])))
                else:
                    waiting[side].append(t)
            yield pd.DataFrame(out, columns=[*keys, "t0", "t1"])

    fields = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)
    return dealt.mapInPandas(match, f"{fields}, t0 double, t1 double")


def band_match(points: DataFrame, keys: list[str], tolerance: float, parts: int | None = None) -> DataFrame:
    """keys, matched, and concordance: the share of the longer of both lists of points (keys, side 0 or 1, t)."""
    sizes = points.groupBy(*keys).agg(F.greatest(F.count(F.when(F.col("side") == 0, 1)), F.count(F.when(F.col("side") == 1, 1))).alias("most"))
    out = sizes.join(matched_points(points, keys, tolerance, parts).groupBy(*keys).agg(F.count("*").alias("matched")), keys, "left")
    return out.select(*keys, F.coalesce("matched", F.lit(0)).alias("matched"), (F.coalesce("matched", F.lit(0)) / F.col("most")).alias("concordance"))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of least total cost, for a matrix of any shape (shortest augmenting paths with potentials)."""
    cost = np.asarray(cost, dtype=float)
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assignment(cost.T))
    n, m = cost.shape
    pot_r, pot_c = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for start in range(n):
        best, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col, reach = start, -1, 0.0
        while True:
            slack = reach + cost[row] - pot_r[row] - pot_c
            better = ~done & (slack < best)
            best[better], via[better] = slack[better], col
            col = int(np.argmin(np.where(done, np.inf, best)))
            reach, done[col] = best[col], True
            if row_of[col] < 0:
                break
            row = row_of[col]
        pot_r[start] += reach
        seen = done.copy()
        seen[col] = False
        for c in np.flatnonzero(seen):
            pot_r[row_of[c]] += reach - best[c]
            pot_c[c] -= reach - best[c]
        while col >= 0:
            before = via[col]
            row_of[col] = start if before < 0 else row_of[before]
            col = before
    return sorted((int(r), int(c)) for c, r in enumerate(row_of) if r >= 0)


def match_profiles(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, features: list[str], scales: list[float], maximum: float) -> DataFrame:
    """Within a key, the one-to-one matches of least total mean scaled distance; those above ``maximum`` go."""
    scale = np.array(scales)
    arrow = [to_arrow_type(df.schema[c].dataType) for df, c in ((left, key), (left, left_id), (right, right_id))]
    side = lambda df, k, a, b: df.select(F.col(key).alias("k"), F.lit(k).alias("side"), a.alias("a"), b.alias("b"), *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)])
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    rows = side(left, 0, F.col(left_id), none(right, right_id)).unionAll(side(right, 1, none(left, left_id), F.col(right_id)))
    dealt = rows.repartition("k").sortWithinPartitions("k", "side", F.asc_nulls_last("a"), F.asc_nulls_last("b"))

    def solve(k, parts: list[tuple]) -> list[tuple]:
        which, a, b, x = (np.concatenate(c) if isinstance(c[0], np.ndarray) else list(itertools.chain(*c)) for c in zip(*parts, strict=True))
        n = int((which == 0).sum())
        if n in (0, len(which)):
            return []
        cost = np.nanmean(np.abs(x[:n, None] - x[None, n:]), axis=2)
        return [(k, a[i], b[n + j], float(cost[i, j])) for i, j in assignment(np.nan_to_num(cost, nan=1e9)) if cost[i, j] <= maximum]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            keys, a, b = (batch.column(i).to_pylist() for i in (0, 2, 3))
            which = batch.column(1).to_numpy(zero_copy_only=False)
            x = np.column_stack([batch.column(4 + i).to_numpy(zero_copy_only=False) for i in range(len(features))]) / scale
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1] and (keys[i] == keys[i] or keys[i - 1] == keys[i - 1])]
            out: list[tuple] = []
            for lo, hi in itertools.pairwise([0, *cuts, len(keys)]):
                if held and keys[lo] != here and (keys[lo] == keys[lo] or here == here):
                    out += solve(here, held)
                    held = []
                here = keys[lo]
                held.append((which[lo:hi], a[lo:hi], b[lo:hi], x[lo:hi]))
            yield table(out)
        if held:
            yield table(solve(here, held))

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([*arrow, pa.float64()])], names=[key, left_id, right_id, "cost"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return dealt.mapInArrow(match, f"{key} {kind(left, key)}, {left_id} {kind(left, left_id)}, {right_id} {kind(right, right_id)}, cost double")


def match_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Permutation and signs of b's columns that line them up with a's, and the Tucker congruences."""
    norm = lambda x: x / np.maximum(np.linalg.norm(x, axis=0), 1e-300)
    phi = norm(a).T @ norm(b)
    k = phi.shape[0]
    best = max(itertools.permutations(range(phi.shape[1]), k), key=lambda p: sum(abs(phi[i, p[i]]) for i in range(k))) if k <= 6 else tuple(j for _, j in assignment(-np.abs(phi)))
    picked = phi[np.arange(k), list(best)]
    return np.array(best), picked
