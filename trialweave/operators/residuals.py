"""Regression residuals from aggregated normal equations: within participants, and with a random intercept of the participant."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions.columns import flag
from trialweave.plans.staging import staged

CONDITIONS = ("congruent", "incongruent", "neutral", "unknown")


def design(trials: DataFrame, source: str = "dataset_id") -> tuple[DataFrame, list[str]]:
    """Adds the regressors x0..: condition and block dummies without the first of each, and a standardised trend over trials.

    Blocks enter as their rank in the source up to three, later ones share the last dummy.  A source may hold a third of all trials, so its figures
    are aggregates that are joined back (a row for each source and each of its blocks), not windows over it.
    """
    block = trials.select(F.col(source).alias("__b_source"), F.col("block_raw").alias("__block")).distinct()
    block = block.withColumn("__rank", F.dense_rank().over(Window.partitionBy("__b_source").orderBy(F.asc_nulls_first("__block"))))
    t = F.col("trial_raw").cast("double")
    figures = trials.groupBy(F.col(source).alias("__f_source")).agg(F.count("*").alias("__n"), F.count(t).alias("__n1"), F.avg(t).alias("__avg"), F.var_pop(t).alias("__var"), F.median(t).alias("__middle"))
    # Of the trend, in which the median stands for missing trials.
    n, n1, avg, middle = (F.col(c) for c in ("__n", "__n1", "__avg", "__middle"))
    mean = (n1 * avg + (n - n1) * middle) / n
    figures = figures.withColumn("__mean", mean).withColumn("__sd", F.sqrt((n1 * (F.col("__var") + F.pow(avg - F.col("__mean"), 2)) + (n - n1) * F.pow(middle - F.col("__mean"), 2)) / n))
    rows = trials.join(block, F.col(source).eqNullSafe(F.col("__b_source")) & F.col("block_raw").eqNullSafe(F.col("__block")), "left")
    rows = rows.join(figures, F.col(source).eqNullSafe(F.col("__f_source")), "left").withColumn("__trend", F.coalesce(t, "__middle"))
    terms = {f"x{i}": (F.coalesce("congruency", F.lit("unknown")) == c).cast("double") for i, c in enumerate(CONDITIONS[1:])}
    k = len(terms)
    terms |= {f"x{k + i}": (F.least("__rank", F.lit(3)) == i + 2).cast("double") for i in range(2)}
    terms[f"x{k + 2}"] = F.when(F.coalesce("__sd", F.lit(0.0)) > 0, (F.col("__trend") - F.col("__mean")) / F.col("__sd")).otherwise(0.0)
    return rows.withColumns(terms).select(*trials.columns, *terms), list(terms)


def residuals(trials: DataFrame, *, y: str, source: str = "dataset_id", person: str = "participant_id", fit_on: str = "valid_correct_rt", apply_to: str = "valid_rt", name: str = "residual") -> DataFrame:
    """Adds <name> and <name>_status: y less design, coefficients and the person's mean residual.

    Both sides are centred on the person over the rows fitted to; X'X and X'y are sums by source, so a source of any size is one small matrix, solved by
    minimum-norm least squares.  A person without fitted rows takes the mean intercept of the source.
    """
    rows, xs = design(trials, source)
    fit = flag(F.col(fit_on)) & F.col(y).isNotNull()
    w = Window.partitionBy(source, person)
    centred = rows.withColumns({f"c_{c}": F.when(fit, F.col(c) - F.avg(F.when(fit, F.col(c))).over(w)) for c in (*xs, y)})
    sums = [F.sum(F.col(f"c_{a}") * F.col(f"c_{b}")).alias(f"s_{a}_{b}") for i, a in enumerate(xs) for b in (*xs[i:], y)]
    means = [F.avg(F.when(fit, F.col(c))).alias(f"m_{c}") for c in (*xs, y)]
    moments = centred.groupBy(source).agg(F.count(F.when(fit, 1)).alias("n_fit"), *sums, *means)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.to_dict("records"):
            a = np.array([[r.get(f"s_{p}_{q}", r.get(f"s_{q}_{p}")) for q in xs] for p in xs], dtype=float)
            b = np.array([r[f"s_{p}_{y}"] for p in xs], dtype=float)
            ok = r["n_fit"] > int((np.abs(np.diag(np.nan_to_num(a))) > 1e-9).sum()) + 1
            beta = np.linalg.pinv(np.nan_to_num(a), rcond=1e-10) @ np.nan_to_num(b)
            out.append({source: r[source], "ok": bool(ok), **{f"b_{c}": float(v) for c, v in zip(xs, beta, strict=True)}})
        return pd.DataFrame(out)

    kind = trials.schema[source].dataType.simpleString()
    betas = moments.groupBy(source).applyInPandas(solve, f"{source} {kind}, ok boolean, " + ", ".join(f"b_{c} double" for c in xs))
    joined = rows.join(betas, source, "left")
    raw = F.col(y) - sum((F.col(c) * F.col(f"b_{c}") for c in xs), F.lit(0.0))
    joined = joined.withColumn("__raw", raw)
    fitted = F.when(fit, F.col("__raw"))
    own = F.avg(fitted).over(Window.partitionBy(source, person))
    joined = joined.withColumn("__own", own)
    people = joined.select(source, person, "__own").distinct().groupBy(source).agg(F.avg("__own").alias("__all"))
    joined = joined.join(people, source, "left")
    use = flag(F.col(apply_to)) & F.col(y).isNotNull() & F.coalesce("ok", F.lit(False))
    status = F.when(~F.coalesce("ok", F.lit(False)), "insufficient_rows_for_design").when(use, "ok").otherwise("not_applicable")
    return joined.withColumns({name: F.when(use, F.col("__raw") - F.coalesce("__own", "__all")), f"{name}_status": status}).select(*trials.columns, name, f"{name}_status")


def _profile(people: DataFrame, p: int, ratios: np.ndarray) -> list[np.ndarray]:
    """For each ratio of variances the sums over participants of log(1 + n ratio) and of c (s, t)(s, t)', c = ratio / (1 + n ratio).

    ``people``: n, t (sum of y) and p sums of regressors a row.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(ratios), 1 + (p + 1) ** 2))
        for b in batches:
            n, *sums = (c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in b.columns)
            z = np.column_stack(sums)
            for i, ratio in enumerate(ratios):
                c = ratio / (1 + n * ratio)
                total[i] += np.concatenate([[np.log1p(n * ratio).sum()], (z.T @ (z * c[:, None])).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(ratios)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    out = [np.zeros(1 + (p + 1) ** 2) for _ in ratios]
    for r in people.mapInArrow(part, "i int, v array<double>").collect():  # a row a task and ratio
        out[r["i"]] = out[r["i"]] + np.array(r["v"])
    return out


def random_intercept(rows: DataFrame, y: str, xs: list[str], person: str, *, least_rows: int = 30, least_people: int = 3, mixed_people: int = 8) -> dict:
    """A linear model of ``y`` by ``xs`` (an intercept is added) with a random intercept of the person, by restricted likelihood.

    The likelihood depends on the ratio of the variances alone, so it is profiled over that one number: first a grid over many magnitudes, then ever finer ones around the best.  Only sums by person and
    their totals are needed; each grid is one pass over a row a person.  With fewer than ``mixed_people`` persons, or without variance between them, persons get intercepts of their own
    (differences from the person's means are fitted).

    Returns status, beta (of xs), ratio, residual variance, n_rows and n_participants.
    """
    ok = F.col(y).isNotNull()
    for x in xs:
        ok &= F.col(x).isNotNull()
    rows = rows.filter(ok & F.col(person).isNotNull()).select(person, F.col(y).cast("double").alias("y"), F.lit(1.0).alias("x0"), *[F.col(x).cast("double").alias(f"x{i + 1}") for i, x in enumerate(xs)])
    p = len(xs) + 1
    z = [*[f"x{i}" for i in range(p)], "y"]
    names = [f"{a}_{b}" for i, a in enumerate(z) for b in z[i:]]
    people = staged(rows.groupBy(person).agg(F.count("*").alias("n"), *[F.sum(a).alias(a) for a in z], *[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(z) for b in z[i:]]), "people")
    centred = [F.sum(F.col(f"{a}_{b}") - F.col(a) * F.col(b) / F.col("n")).alias(f"w_{a}_{b}") for i, a in enumerate(z) for b in z[i:]]
    t = people.agg(F.sum("n").alias("n"), F.count("*").alias("people"), *[F.sum(c).alias(c) for c in names], *centred).first()
    n, count = int(t["n"] or 0), int(t["people"])
    out = {"status": "not_testable", "beta": [None] * len(xs), "ratio": None, "variance": None, "n_rows": n, "n_participants": count}
    if n < least_rows or count < least_people:
        return out

    def square(prefix: str) -> np.ndarray:
        m = np.zeros((p + 1, p + 1))
        m[np.triu_indices(p + 1)] = [t[prefix + c] for c in names]
        return m + np.triu(m, 1).T

    total, within = square(""), square("w_")
    keep = np.flatnonzero(np.diag(total)[:p] > 1e-12)
    # Regressors that others express take no part (minimum-norm answer).
    rank = int(np.linalg.matrix_rank(total[np.ix_(keep, keep)], hermitian=True))

    def fit(ratio: float, sums: np.ndarray) -> tuple[float, np.ndarray, float]:
        m = total - sums[1:].reshape(p + 1, p + 1)
        a, b = m[np.ix_(keep, keep)], m[keep, p]
        value, vector = np.linalg.eigh(a)
        value, vector = value[-rank:], vector[:, -rank:]
        beta = np.zeros(p)
        beta[keep] = vector @ ((vector.T @ b) / value)
        rss = max(float(m[p, p] - beta[keep] @ b), 1e-300)
        return -0.5 * ((n - rank) * np.log(rss / (n - rank)) + sums[0] + np.log(value).sum()), beta, rss / (n - rank)

    if count >= mixed_people and n > rank:
        grid = np.concatenate([[0.0], np.logspace(-6, 6, 61)])
        narrow = people.select("n", *z)
        for _ in range(4):
            fits = [fit(r, s) for r, s in zip(grid, _profile(narrow, p, grid), strict=True)]
            at = int(np.argmax([f[0] for f in fits]))
            best = grid[at]
            if best == 0:
                break
            grid = np.geomspace(max(grid[max(at - 1, 0)], best / 10), grid[min(at + 1, len(grid) - 1)] if at + 1 < len(grid) else best * 10, 41)
        _, beta, variance = fits[at]
        if best * variance > 1e-8:
            return out | {"status": "mixed", "beta": beta[1:].tolist(), "ratio": float(best), "variance": float(variance)}
    beta = np.linalg.pinv(within[1:p, 1:p], rcond=1e-10, hermitian=True) @ within[1:p, p]
    return out | {"status": "participant_intercepts", "beta": beta.tolist()}
