"""Preprocessing, components, mixtures, linear models and their metrics.

Sums over rows are Spark aggregates (moments, scatter matrices, responsibilities by partition); the small matrices they give are
worked on by NumPy on the driver.  Nothing collects rows, except the group-wise fits that say so.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions.columns import quantiles, safe_div
from trialweave.operators.resampling import counts_of
from trialweave.plans.staging import staged

# --- preprocessing ---------------------------------------------------------------------------------------------------------------------------------------------------


def select_features(df: DataFrame, candidates: list[str], *, most_missing: float = 0.2, complete: float = 0.8, least: int = 5) -> list[str]:
    """Candidates that are present and vary; then the most missing go until enough rows are complete.

    One pass gives missing shares and spreads, one more the counts of each pattern of missing columns.
    """
    stats = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"n_{c}") for c in candidates], *[F.count_distinct(c).alias(f"d_{c}") for c in candidates]).first()
    n = stats["n"] or 1
    keep = [c for c in candidates if 1 - stats[f"n_{c}"] / n <= most_missing and stats[f"d_{c}"] > 1]
    missing = {c: n - stats[f"n_{c}"] for c in keep}
    patterns = df.groupBy(F.array(*[F.col(c).isNull() for c in keep]).alias("p")).count().collect() if keep else []

    def share(cols: list[str]) -> float:
        at = [keep.index(c) for c in cols]
        return sum(r["count"] for r in patterns if not any(r["p"][i] for i in at)) / n

    chosen = list(keep)
    while len(chosen) > least and share(chosen) < complete:
        chosen.remove(max(chosen, key=lambda c: (missing[c], candidates.index(c))))
    return chosen


def median_impute(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing values as the exact median; an error where a column has none."""
    med = df.agg(*[F.median(c).alias(c) for c in features]).first().asDict()
    if none := [c for c, v in med.items() if v is None]:
        raise ValueError(f"no median: {none}")
    return df.withColumns({c: F.coalesce(c, F.lit(med[c])) for c in features})


def robust_scale(df: DataFrame, features: list[str]) -> DataFrame:
    """(x - median) / IQR by exact quantiles; an IQR of 0 counts as 1.  ``df`` is written once."""
    df = staged(df, "unscaled")
    found = quantiles(df, {c: F.col(c) for c in features}, [0.25, 0.5, 0.75]).get((), {})
    q = {c: found.get(c) or [None] * 3 for c in features}
    spread = {c: v[2] - v[0] if v[0] is not None else 1.0 for c, v in q.items()}
    return df.withColumns({c: (F.col(c) - F.lit(q[c][1])) / F.lit(spread[c] or 1.0) for c in features})


def standard_scale(df: DataFrame, features: list[str], keys: list[str] | None = None) -> DataFrame:
    """(x - mean) / population sd; a spread of 0 counts as 1."""
    if not keys:  # one row of figures; a window without keys would bring all rows to one task
        s = df.agg(*[f(c).alias(f"{c}_{k}") for c in features for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        return df.withColumns({c: (F.col(c) - F.lit(s[f"{c}_m"])) / F.lit(s[f"{c}_s"] or 1.0) for c in features})
    w = Window.partitionBy(*keys)
    sd = lambda c: F.stddev_pop(c).over(w)
    return df.withColumns({c: (F.col(c) - F.avg(c).over(w)) / F.when(sd(c) > 0, sd(c)).otherwise(1.0) for c in features})


def person_centre(df: DataFrame, person: str, features: list[str]) -> DataFrame:
    w = Window.partitionBy(person)
    return df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in features})


# --- components ------------------------------------------------------------------------------------------------------------------------------------------------------


def moments(df: DataFrame, features: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and population covariance over complete rows, from sums by partition (each around its own means, then merged)."""
    p = len(features)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, scatter = 0, np.zeros(p), np.zeros((p, p))
        for b in batches:
            x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in b.columns])
            x = x[np.isfinite(x).all(axis=1)]
            if len(x):
                n, mean, scatter = _merge((n, mean, scatter), (len(x), x.mean(axis=0), (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()]), pa.array([scatter.ravel().tolist()])], names=["n", "m", "s"])

    total = (0, np.zeros(p), np.zeros((p, p)))
    for r in df.select(*features).mapInArrow(part, "n long, m array<double>, s array<double>").collect():
        total = _merge(total, (r["n"], np.array(r["m"]), np.array(r["s"]).reshape(p, p)))
    n, mean, scatter = total
    return n, mean, scatter / max(n, 1)


def _merge(a, b):
    n = a[0] + b[0]
    if not b[0]:
        return a
    gap = b[1] - a[1]
    return n, a[1] + gap * b[0] / n, a[2] + b[2] + np.outer(gap, gap) * a[0] * b[0] / n


def components(covariance: np.ndarray, k: int | None = None, variance: float = 0.8, most: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Loadings (features by components) and variance shares; as many components as reach ``variance``, ``most`` at most, or ``k``.

    The largest loading of each component is positive.
    """
    value, vector = np.linalg.eigh(covariance)
    value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
    share = value / value.sum() if value.sum() > 0 else value
    if k is None:
        k = min(int(np.searchsorted(np.cumsum(share), variance - 1e-12) + 1), most, len(share))
    vector = vector[:, :k]
    return vector * np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(k)]), share[:k]


def component_scores(df: DataFrame, features: list[str], mean: np.ndarray, loadings: np.ndarray, name: str = "pc") -> DataFrame:
    return df.withColumns({f"{name}{j + 1}": sum(((F.col(c) - float(mean[i])) * float(loadings[i, j]) for i, c in enumerate(features)), F.lit(0.0)) for j in range(loadings.shape[1])})


def fixed_components(df: DataFrame, person: str, features: list[str], k: int, key: str, *, least: int = 5, parallel: bool = True) -> tuple[np.ndarray, np.ndarray, DataFrame, dict]:
    """Loadings, variance shares, ``df`` of complete rows with scores ``component_1`` ..., and what was fitted: k components of person-centred, standardised features."""
    rows = staged(person_centre(df, person, features).dropna(subset=features), "centred")
    people = rows.agg(F.count_distinct(person)).first()[0]
    if people < least:
        raise ValueError(f"at least {least} participants are required")
    rows = standard_scale(rows, features)
    n, mean, cov = moments(rows, features)
    load, share = components(cov, k)
    count = None
    if parallel:
        null = permuted_covariances(rows, key, features, mean, cov)
        count = parallel_count(null.__getitem__, len(features), cov, len(null), most=min(5, len(features)))
    scores = component_scores(rows, features, mean, load, "component_")
    return load, share, scores, {"n_windows": n, "n_participants": people, "fixed_components": k, "parallel_analysis_components": count}


def autonomic_dimensions(df: DataFrame, person: str, features: list[str], mode: str, most: int, key: str, *, available: float = 0.8) -> tuple[np.ndarray, np.ndarray, list[str], DataFrame | None, dict]:
    """Loadings, variance shares, the features used, scores and status: components between participants (of their means) or within them, as many as beat permuted columns."""
    if mode not in ("between", "within"):
        raise ValueError("mode must be between or within")
    none = np.zeros((0, 0))
    shares = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in features]).first()
    used = [c for c in features if (shares[c] or 0) >= available]
    if len(used) < 3:
        return none, none, used, None, {"status": "not_testable", "reason": "fewer than three HRV features", "n_factors": None, "n_observations": None}
    if mode == "between":
        source = df.groupBy(person).agg(*[F.avg(c).alias(c) for c in used]).dropna(subset=used).withColumn(key, F.col(person).cast("string"))
    else:
        source = person_centre(df.select(person, key, *used).dropna(subset=used), person, used)
    source = staged(source, "source")
    n = source.count()
    if n < max(8, len(used) + 1):
        return none, none, used, None, {"status": "not_testable", "reason": "insufficient complete observations", "n_factors": None, "n_observations": n}
    rows = staged(standard_scale(source, used), "scaled")
    _, mean, cov = moments(rows, used)
    null = permuted_covariances(rows, key, used, mean, cov)
    k = parallel_count(null.__getitem__, len(used), cov, len(null), most=min(most, len(used)))
    load, share = components(cov, k)
    return load, share, used, component_scores(rows, used, mean, load, f"ans_{mode}_component_"), {"status": "ok", "reason": None, "n_factors": k, "n_observations": n}


def parallel_count(covariance_of, n_features: int, real: np.ndarray, repetitions: int = 100, q: float = 0.95, most: int = 6) -> int:
    """Components whose eigenvalue beats the quantile of those of permuted columns; ``covariance_of(seed)`` gives one such covariance."""
    null = np.array([np.sort(np.linalg.eigvalsh(covariance_of(s)))[::-1] for s in range(repetitions)])
    above = np.sort(np.linalg.eigvalsh(real))[::-1] > np.quantile(null, q, axis=0)
    count = int(np.argmin(above)) if not above.all() else n_features
    return min(max(count, 1), most)


def permuted_covariances(df: DataFrame, key: str, features: list[str], mean: np.ndarray, covariance: np.ndarray, repetitions: int = 100) -> list[np.ndarray]:
    """Covariances of all complete rows with each column permuted by itself: in a repetition a column is in the order of a hash of ``key``, its number and the repetition's.

    Permuting leaves means and variances alone, so only products of the reordered, centred columns are summed.
    """
    p = len(features)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & ~F.col(c).isin(float("inf"), float("-inf"))
    rows = df.filter(" and ".join(f"`{c}` is not null" for c in features))
    for c in features:
        rows = rows.filter(finite(c))
    columns = F.array(*[F.struct(F.lit(i).alias("c"), (F.col(c).cast("double") - float(mean[i])).alias("v")) for i, c in enumerate(features)])
    long = rows.select(F.col(key).alias("k"), F.explode(columns).alias("x")).select("k", "x.c", "x.v").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
    turn = Window.partitionBy("r", "c").orderBy(F.xxhash64("k", "c", "r"), "k", "v")
    at = long.withColumn("at", F.row_number().over(turn)).groupBy("r", "at").agg(*[F.max(F.when(F.col("c") == i, F.col("v"))).alias(f"v{i}") for i in range(p)])
    pairs = [(i, j) for i in range(p) for j in range(i)]
    sums = at.groupBy("r").agg(F.count("*").alias("n"), *[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"s{i}_{j}") for i, j in pairs])
    out = []
    for r in sums.orderBy("r").collect():
        cov = np.diag(np.diag(covariance)).astype(float)
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"s{i}_{j}"] / r["n"]
        out.append(cov)
    return out


def person_scatter(df: DataFrame, person: str, features: list[str]) -> DataFrame:
    """Each person's rows and scatter matrix of centred features: additive, so resampled covariances are sums of these."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    rows = person_centre(df.dropna(subset=features), person, features)
    return rows.groupBy(person).agg(F.count("*").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs])


def scatter_matrix(sums: np.ndarray, n: float, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = sums
    return (out + np.triu(out, 1).T) / max(n, 1)


def subspace_similarity(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Singular values between the spans of two loading matrices, and the largest principal angle in degrees."""
    q = lambda x: np.linalg.qr(x)[0]
    s = np.clip(np.linalg.svd(q(a).T @ q(b), compute_uv=False), 0, 1)
    return s, float(np.degrees(np.arccos(s.min())))


# --- mixtures --------------------------------------------------------------------------------------------------------------------------------------------------------


def _log_density(x: np.ndarray, means: np.ndarray, cov: np.ndarray, kind: str) -> np.ndarray:
    d = x.shape[1]
    if kind == "diag":
        return -0.5 * (((x[:, None] - means) ** 2 / cov).sum(axis=2) + np.log(cov).sum(axis=1) + d * math.log(2 * math.pi))
    out = np.empty((len(x), len(means)))
    for j in range(len(means)):
        low = np.linalg.cholesky(cov[j])
        z = np.linalg.solve(low, (x - means[j]).T)
        out[:, j] = -0.5 * ((z**2).sum(axis=0) + d * math.log(2 * math.pi)) - np.log(np.diag(low)).sum()
    return out


def parameter_count(k: int, d: int, kind: str) -> int:
    return k * d + k * (d if kind == "diag" else d * (d + 1) // 2) + k - 1


def enough_rows(sizes: np.ndarray, least: int = 20, share: float = 0.05) -> bool:
    """Whether every component holds ``least`` rows and that share of all."""
    return bool(len(sizes)) and bool((sizes >= np.maximum(least, share * sizes.sum())).all())


def well_conditioned(covariances: np.ndarray, kind: str, most: float = 1e8) -> bool:
    """Whether full covariances can be inverted safely; diagonal ones always count as such."""
    if kind == "diag":
        return True
    found = np.linalg.cond(covariances)
    return bool(len(found)) and bool((np.isfinite(found) & (found < most)).all())


#: Densities, or counts of replicates, that a task holds at once.
HELD = 1 << 19


def _log_coefficients(m: dict, centre: np.ndarray) -> np.ndarray:
    """Columns, one a component: the log of weight times density as a quadratic in a row less ``centre``: 1, the features, then their products (i, j >= i)."""
    d = len(centre)
    mu, upper, out = m["means"] - centre, np.triu_indices(d), []
    for j in range(len(mu)):
        if m["kind"] == "diag":
            precision, log_det = np.diag(1 / m["cov"][j]), np.log(m["cov"][j]).sum()
        else:
            low = np.linalg.cholesky(m["cov"][j])
            inverse = np.linalg.solve(low, np.eye(d))
            precision, log_det = inverse.T @ inverse, 2 * np.log(np.diag(low)).sum()
        linear = precision @ mu[j]
        products = np.where(upper[0] == upper[1], -0.5, -1.0) * precision[upper]
        out.append(np.concatenate([[np.log(m["weights"][j]) - 0.5 * (d * math.log(2 * math.pi) + log_det + mu[j] @ linear)], linear, products]))
    return np.array(out).T


def weighed(df: DataFrame, features: list[str], replicates: int, weigh: tuple[list[str], Callable[[list[pa.Array]], np.ndarray]] | None = None) -> DataFrame:
    """The different rows of ``features``, and ``t``: how often each counts in every replicate (once for each of its rows, without ``weigh``).

    Written once, so that rounds read neither participants nor draw their counts again, and copies of a row are one row.
    """
    rows = df.select(*features, *(weigh[0] if weigh else [])).dropna(subset=features)
    if not weigh:
        return staged(rows.groupBy(*features).agg(F.array(F.count(F.lit(1)).cast("double")).alias("t")), "weighed")
    schema, step = ", ".join(f"`{c}` double" for c in features) + ", t array<double>", max(1, HELD // replicates)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                times = np.ascontiguousarray(weigh[1](part.columns[len(features) :]), dtype=float)
                t = pa.ListArray.from_arrays(pa.array(np.arange(len(times) + 1) * replicates, pa.int32()), pa.array(times.ravel()))
                yield pa.RecordBatch.from_arrays([*[c.cast(pa.float64()) for c in part.columns[: len(features)]], t], names=[*features, "t"])

    each = rows.mapInArrow(drawn, schema)
    return staged(each.groupBy(*features).agg(F.array(*[F.sum(F.col("t")[r]) for r in range(replicates)]).alias("t")), "weighed")


def mixture_sums(rows: DataFrame, features: list[str], candidates: list[dict], centre: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """For each candidate the sums of a pass over rows of :func:`weighed`: log likelihood, entropy, responsibilities, sizes, first and second moments.

    A candidate counts by its ``replicate``.  All densities of some rows are one product of matrices, and so are all moments; rows are taken less ``centre``.
    """
    d = len(features)
    centre = np.zeros(d) if centre is None else centre
    # Candidates of one number of components stand together: they are one array.
    order = sorted(range(len(candidates)), key=lambda i: candidates[i]["k"])
    groups = [(k, [i for i in order if candidates[i]["k"] == k]) for k in sorted({m["k"] for m in candidates})]
    coefficients = np.concatenate([_log_coefficients(candidates[i], centre) for i in order], axis=1) if order else np.zeros((1, 0))
    shared = rows.sparkSession.sparkContext.broadcast((coefficients, [(k, [candidates[i]["replicate"] for i in at]) for k, at in groups]))
    upper = np.triu_indices(d)
    width = 1 + d + len(upper[0])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta, kinds = shared.value
        step = max(64, HELD // max(1, beta.shape[1]))
        held = np.zeros((beta.shape[1], width + 1))
        logs = [np.zeros((2, len(at))) for _, at in kinds]
        for b in batches:
            x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in b.columns[:d]]) - centre
            t_all = b.column(d).flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            for lo in range(0, len(x), step):
                y, times = x[lo : lo + step], t_all[lo : lo + step]
                phi = np.concatenate([np.ones((len(y), 1)), y, y[:, upper[0]] * y[:, upper[1]]], axis=1)
                lp = phi @ beta
                at = 0
                for (k, replicate), sums in zip(kinds, logs, strict=True):
                    span = slice(at, at + k * len(replicate))
                    p = lp[:, span].reshape(len(y), -1, k)
                    t = times[:, replicate]
                    if k == 1:
                        sums[0] += (p[:, :, 0] * t).sum(axis=0)
                        r, size = t[:, :, None], t[:, :, None]
                    else:
                        top = p.max(axis=2, keepdims=True)
                        size = (np.arange(k) == p.argmax(axis=2)[:, :, None]) * t[:, :, None]
                        p = p - top
                        r = np.exp(p)
                        whole = r.sum(axis=2, keepdims=True)
                        log_whole = np.log(whole)
                        sums[0] += ((top + log_whole)[:, :, 0] * t).sum(axis=0)
                        r /= whole
                        sums[1] -= ((r * (p - log_whole)).sum(axis=2) * t).sum(axis=0)
                        r *= t[:, :, None]
                    held[span, :width] += r.reshape(len(y), -1).T @ phi
                    held[span, width] += size.reshape(len(y), -1).sum(axis=0)
                    at = span.stop
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary()), pa.array([b"".join(s.tobytes() for s in logs)], pa.binary())], names=["v", "l"])

    v, logs = np.zeros((coefficients.shape[1], width + 1)), np.zeros(2 * len(candidates))
    for r in rows.mapInArrow(part, "v binary, l binary").collect():  # a row a task
        v, logs = v + np.frombuffer(r["v"]).reshape(v.shape), logs + np.frombuffer(r["l"])
    total: dict[int, np.ndarray] = {}
    at = of = 0
    for k, members in groups:
        ll, entropy = logs[of : of + 2 * len(members)].reshape(2, -1)
        of += 2 * len(members)
        for n, i in enumerate(members):
            s = v[at : at + k]
            at += k
            if not s[:, 0].any():
                continue
            size, first = s[:, 0], s[:, 1 : 1 + d]
            second = np.zeros((k, d, d))
            second[:, upper[0], upper[1]] = second[:, upper[1], upper[0]] = s[:, 1 + d : width]
            total[i] = np.concatenate([[ll[n], entropy[n]], size, s[:, width], first.ravel(), second.ravel()])
    return total


def mixture_sweep(
    df: DataFrame, features: list[str], *, ks: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 7, 8), kinds: tuple[str, ...] = ("diag", "full"), starts: int = 20, rounds: int = 100, ridge: float = 1e-6, seed: int = 42,
    tolerance: float = 1e-3, replicates: int = 1, weigh: tuple[list[str], Callable[[list[pa.Array]], np.ndarray]] | None = None,
) -> list[dict]:
    """Gaussian mixtures for each k and covariance kind, best of several starts; sorted by BIC.  With ``weigh``, a set of them for each of the ``replicates``.

    All candidates share the passes: a round is one job in which each task adds up responsibilities, first and second moments of every
    candidate over its rows, so only sums leave a task.  A candidate rests once a round gains less than ``tolerance`` a row.
    """
    _, mean, cov = moments(df, features)
    d = len(features)
    rng = np.random.default_rng(seed)
    scale = np.sqrt(np.maximum(np.diag(cov), ridge))
    models = []
    for replicate in range(replicates):
        for kind in kinds:
            for k in ks:
                for _ in range(starts if k > 1 else 1):
                    c = np.tile(np.maximum(np.diag(cov), ridge), (k, 1)) if kind == "diag" else np.tile(cov + ridge * np.eye(d), (k, 1, 1))
                    models.append({"replicate": replicate, "kind": kind, "k": k, "weights": np.full(k, 1 / k), "means": mean + scale * rng.normal(0, 1, (k, d)) if k > 1 else mean[None].copy(), "cov": c, "ll": -np.inf})
    rows = weighed(df, features, replicates, weigh)
    live = list(range(len(models)))
    for round_ in range(rounds + 1):
        total = mixture_sums(rows, features, [models[i] for i in live], mean)
        still = []
        for at, i in enumerate(live):
            m = models[i]
            k = m["k"]
            if at not in total:  # no rows
                m |= {"ll": 0.0, "entropy": 0.0, "sizes": np.zeros(k, int), "n": 0.0}
                continue
            v = total[at]
            gain = v[0] - m["ll"]
            m["ll"], m["entropy"], r, m["sizes"] = v[0], v[1], v[2 : 2 + k], v[2 + k : 2 + 2 * k].astype(int)
            m["n"] = float(r.sum())
            if (round_ and gain < tolerance * m["n"]) or round_ == rounds:
                continue
            first = v[2 + 2 * k : 2 + 2 * k + k * d].reshape(k, d)
            second = v[2 + 2 * k + k * d :].reshape(k, d, d)
            r = np.maximum(r, 1e-9)
            mu = first / r[:, None]  # less the centre, as are the moments
            if m["kind"] == "diag":
                c = np.maximum(np.diagonal(second, axis1=1, axis2=2) / r[:, None] - mu**2, 0) + ridge
            else:
                c = second / r[:, None, None] - np.einsum("ij,ik->ijk", mu, mu)
                c = (c + c.transpose(0, 2, 1)) / 2
                value, vector = np.linalg.eigh(c)
                c = np.einsum("aij,aj,akj->aik", vector, np.maximum(value, 0) + ridge, vector)
            m["weights"], m["means"], m["cov"] = r / r.sum(), mu + mean, c
            still.append(i)
        live = still
        if not live:
            break
    best: dict[tuple[int, str, int], dict] = {}
    for m in models:
        key = (m["replicate"], m["kind"], m["k"])
        if key not in best or m["ll"] > best[key]["ll"]:
            best[key] = m
    out = []
    for m in best.values():
        free, n = parameter_count(m["k"], d, m["kind"]), m["n"]
        conditions = [float(c.max() / c.min()) if m["kind"] == "diag" else float(np.linalg.cond(c)) for c in m["cov"]]
        m |= {"bic": -2 * m["ll"] + free * math.log(max(n, 1)), "aic": -2 * m["ll"] + 2 * free, "parameters": free,
              "valid": bool(m["sizes"].min() >= max(20, 0.05 * n) and max(conditions) < 1e8 and (m["kind"] == "diag" or n > 10 * free)),
              "posterior_entropy": float(m["entropy"] / max(n, 1) / math.log(m["k"])) if m["k"] > 1 else 0.0}
        order = np.argsort(m["means"][:, 0])
        m["weights"], m["means"], m["cov"] = m["weights"][order], m["means"][order], m["cov"][order]
        out.append(m)
    return sorted(out, key=lambda m: (m["replicate"], not m["valid"], m["bic"]))


def by_participant(person: str, repetitions: int, seed: int = 42) -> tuple[list[str], Callable[[list[pa.Array]], np.ndarray]]:
    """Weights of rows in bootstraps of whole participants: replicates with Poisson(1) counts."""

    def times(columns: list[pa.Array]) -> np.ndarray:
        people = columns[0].dictionary_encode()
        return counts_of(people.dictionary.to_pylist(), repetitions, seed)[people.indices.to_numpy(zero_copy_only=False)]

    return [person], times


def leaving_out(column: str, values: list) -> tuple[list[str], Callable[[list[pa.Array]], np.ndarray]]:
    """Weights 0 for the rows of one value in each replicate, else 1."""

    def times(columns: list[pa.Array]) -> np.ndarray:
        held = columns[0].to_pylist()
        return np.array([[float(x != v) for v in values] for x in held]).reshape(len(held), len(values))

    return [column], times


def by_split(person: str, splits: int, share: float = 0.25, seed: int = 42, *, test: bool = False) -> tuple[list[str], Callable[[list[pa.Array]], np.ndarray]]:
    """Weights of the training (or test) rows of random splits of whole participants."""

    def times(columns: list[pa.Array]) -> np.ndarray:
        people = columns[0].dictionary_encode()
        drawn = np.array([np.random.default_rng([seed, zlib.crc32(str(p).encode())]).random(splits) < share for p in people.dictionary.to_pylist()]).reshape(-1, splits)
        return (drawn == test)[people.indices.to_numpy(zero_copy_only=False)].astype(float)

    return [person], times


def weighted_moments(df: DataFrame, features: list[str], weigh: tuple[list[str], Callable[[list[pa.Array]], np.ndarray]]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """(weight, mean, covariance) of each replicate, over complete rows."""
    d = len(features)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), *[c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in b.columns[:d]]])
            v = np.einsum("ir,ij,ik->rjk", weigh[1](b.columns[d:]), x, x, optimize=True)
            total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([v.ravel().tolist() for v in total], pa.list_(pa.float64()))], names=["r", "v"])

    sums: dict[int, np.ndarray] = {}
    for row in df.select(*features, *weigh[0]).dropna(subset=features).mapInArrow(part, "r int, v array<double>").collect():
        sums[row["r"]] = sums.get(row["r"], 0) + np.array(row["v"]).reshape(d + 1, d + 1)
    out = {}
    for r, v in sums.items():
        n = v[0, 0]
        mean = v[0, 1:] / max(n, 1e-9)
        out[r] = n, mean, v[1:, 1:] / max(n, 1e-9) - np.outer(mean, mean)
    return out


def agreements(df: DataFrame, features: list[str], base: dict, candidates: list[dict], left_out: tuple[str, list] | None = None) -> list[float | None]:
    """Adjusted Rand index of each candidate's labels with those of ``base``, over all rows, or over the rows its replicate left out."""
    d = len(features)
    shared = df.sparkSession.sparkContext.broadcast((base, candidates))

    def labels(x: np.ndarray, m: dict) -> np.ndarray:
        return (_log_density(x, m["means"], m["cov"], m["kind"]) + np.log(m["weights"])).argmax(axis=1)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple[int, int, int], int] = {}
        for b in batches:
            x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in b.columns[:d]])
            if not len(x):
                continue
            first = labels(x, shared.value[0])
            held = b.column(d).to_pylist() if left_out else None
            for i, m in enumerate(shared.value[1]):
                at = np.array([v == left_out[1][m["replicate"]] for v in held]) if left_out else slice(None)
                pair, n = np.unique(first[at] * 1000 + labels(x, m)[at], return_counts=True)
                for q, k in zip(pair.tolist(), n.tolist(), strict=True):
                    cells[i, q // 1000, q % 1000] = cells.get((i, q // 1000, q % 1000), 0) + k
        yield pa.RecordBatch.from_arrays([pa.array([c[j] for c in cells], pa.int32()) for j in range(3)] + [pa.array(list(cells.values()), pa.int64())], names=["i", "a", "b", "n"])

    rows = df.select(*features, *([left_out[0]] if left_out else [])).dropna(subset=features)
    tables: list[dict[tuple[int, int], int]] = [{} for _ in candidates]
    for r in rows.mapInArrow(part, "i int, a int, b int, n long").groupBy("i", "a", "b").agg(F.sum("n").alias("n")).collect():
        tables[r["i"]][r["a"], r["b"]] = r["n"]
    return [rand_index(t) for t in tables]


def rand_index(cells: dict[tuple[int, int], int]) -> float | None:
    """Adjusted Rand index of a contingency table; 1 for two labellings of one class each."""
    pairs = lambda n: n * (n - 1) / 2
    rows: dict[int, int] = {}
    columns: dict[int, int] = {}
    for (a, b), n in cells.items():
        rows[a], columns[b] = rows.get(a, 0) + n, columns.get(b, 0) + n
    total = pairs(sum(cells.values()))
    if not total:
        return None
    same, a, b = (sum(map(pairs, x.values())) for x in (cells, rows, columns))
    expected = a * b / total
    return 1.0 if (a + b) / 2 == expected else float((same - expected) / ((a + b) / 2 - expected))


def assign(df: DataFrame, features: list[str], model: dict, name: str = "component") -> DataFrame:
    """The most likely component of each row, and its posterior."""
    kind, w, mu, c = model["kind"], model["weights"], model["means"], model["cov"]

    @F.pandas_udf("component int, posterior double")
    def label(*cols: pd.Series) -> pd.DataFrame:
        x = np.column_stack([s.to_numpy(float) for s in cols])
        ok = np.isfinite(x).all(axis=1)
        lp = _log_density(np.nan_to_num(x), mu, c, kind) + np.log(w)
        p = np.exp(lp - lp.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return pd.DataFrame({"component": pd.array(np.where(ok, p.argmax(axis=1), -1), "Int32").astype("Int32"), "posterior": np.where(ok, p.max(axis=1), np.nan)})

    out = df.withColumn("__l", label(*features))
    return out.select(*df.columns, F.nullif(F.col("__l.component"), F.lit(-1)).alias(name), F.when(~F.isnan("__l.posterior"), F.col("__l.posterior")).alias("posterior"))


# --- metrics and folds -----------------------------------------------------------------------------------------------------------------------------------------------


def adjusted_rand(df: DataFrame, left: str, right: str) -> DataFrame:
    """Agreement of two labellings, from their contingency table."""
    c = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(left, right).agg(F.count("*").alias("k"))
    pairs = lambda n: n * (n - 1) / 2
    a = c.groupBy(left).agg(F.sum("k").alias("k")).agg(F.sum(pairs(F.col("k"))).alias("a"))
    b = c.groupBy(right).agg(F.sum("k").alias("k")).agg(F.sum(pairs(F.col("k"))).alias("b"))
    t = c.agg(F.sum(pairs(F.col("k"))).alias("same"), F.sum("k").alias("n"))
    expected = F.col("a") * F.col("b") / pairs(F.col("n"))
    return t.join(a, F.lit(True)).join(b, F.lit(True)).select(F.col("n"), safe_div(F.col("same") - expected, (F.col("a") + F.col("b")) / 2 - expected).alias("ari"))


def partition_jaccard(df: DataFrame, reference: str, candidate: str) -> DataFrame:
    """One row: the mean over the clusters of ``reference`` of the best overlap (intersection over union) with one of ``candidate``; null and -1 are noise."""
    a, b = F.col(reference), F.col(candidate)
    c = df.select(F.when(a.cast("string") != "-1", a).alias("a"), F.when(b.cast("string") != "-1", b).alias("b")).groupBy("a", "b").agg(F.count("*").alias("k"))
    left = c.filter("a is not null").groupBy("a").agg(F.sum("k").alias("n"))
    right = c.filter("b is not null").groupBy("b").agg(F.sum("k").alias("m"))
    best = c.filter("a is not null and b is not null").join(right, "b").join(left, "a").groupBy("a").agg(F.max(F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).alias("j"))
    found = left.join(best, "a", "left").agg(F.avg(F.coalesce("j", F.lit(0.0))).alias("j"))
    return found.join(right.agg(F.count("*").alias("clusters")), F.lit(True)).select(F.when(F.col("clusters") > 0, F.col("j")).alias("partition_jaccard"))


def posterior_entropy(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the mean entropy of a row's probabilities, in units of the logarithm of their number."""
    p = [F.least(F.greatest(F.col(c).cast("double"), F.lit(1e-12)), F.lit(1.0)) for c in columns]
    h = sum((-x * F.ln(x) for x in p), F.lit(0.0)) / math.log(len(columns)) if len(columns) > 1 else F.lit(0.0)
    return df.agg(F.avg(h).alias("posterior_entropy"))


def labelled(df: DataFrame, features: list[str], candidates: list[dict]) -> DataFrame:
    """``df`` with a column ``m0``, ``m1``, ... of the most likely component for each mixture, in one pass."""
    schema = ", ".join(f"m{i} int" for i in range(len(candidates)))

    @F.pandas_udf(f"struct<{schema.replace(' int', ':int')}>")
    def label(*cols: pd.Series) -> pd.DataFrame:
        x = np.column_stack([s.to_numpy(float) for s in cols])
        return pd.DataFrame({f"m{i}": (_log_density(x, m["means"], m["cov"], m["kind"]) + np.log(m["weights"])).argmax(axis=1).astype(np.int32) for i, m in enumerate(candidates)})

    out = df.dropna(subset=features).withColumn("__m", label(*features))
    return out.select(*df.columns, "__m.*")


def group_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """Adds ``fold``: groups of one size are dealt in turns, so folds hold alike numbers of groups and rows; a group has one fold.

    Turns are taken within a size, so no task orders all groups.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    turn = F.row_number().over(Window.partitionBy("n").orderBy(group)) - 1
    return df.join(sizes.select(group, F.pmod(turn + F.col("n"), F.lit(folds)).cast("int").alias("fold")), group, "left")


def leakage(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count_distinct("fold").alias("f")).agg(F.count_if(F.col("f") > 1).alias("leaked_groups"))


def _prepared(train: pd.DataFrame, test: pd.DataFrame, numeric: list[str], categorical: list[str]):
    """Median imputation with indicators, robust scaling and one-hot codes, all from the training rows."""
    a, b = [], []
    for c in numeric:
        x, z = train[c].to_numpy(float), test[c].to_numpy(float)
        med = np.nanmedian(x) if np.isfinite(x).any() else 0.0
        if np.isnan(x).any():
            a.append(np.isnan(x).astype(float))
            b.append(np.isnan(z).astype(float))
        x, z = np.where(np.isnan(x), med, x), np.where(np.isnan(z), med, z)
        iqr = (np.quantile(x, 0.75) - np.quantile(x, 0.25)) or 1.0
        a.append((x - np.median(x)) / iqr)
        b.append((z - np.median(x)) / iqr)
    for c in categorical:
        for v in sorted(train[c].dropna().unique()):
            a.append((train[c] == v).to_numpy(float))
            b.append((test[c] == v).to_numpy(float))
    return (np.column_stack(a), np.column_stack(b)) if a else (np.zeros((len(train), 0)), np.zeros((len(test), 0)))


def summed(rows: DataFrame, columns: list[str], of: Callable[[dict[str, np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """The sum over all batches of rows of a vector of their columns (numbers with NaN for null, others as objects); a row a task is collected."""
    texts = {c for c in columns if rows.schema[c].dataType.simpleString() == "string"}

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = {c: np.array(v.to_pylist(), dtype=object) if c in texts else v.cast(pa.float64()).to_numpy(zero_copy_only=False) for c, v in zip(columns, b.columns, strict=True)}
                v = of(x)
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    found = [np.array(r["v"]) for r in rows.select(*columns).mapInArrow(part, "v array<double>").collect()]
    return sum(found[1:], found[0]) if found else None


class FoldDesign:
    """Median imputation with indicators, robust scaling and one-hot codes for each fold, all from its training rows (``fold`` is another), by aggregates."""

    def __init__(self, rows: DataFrame, numeric: list[str], categorical: list[str], folds: int) -> None:
        self.numeric, self.categorical, self.folds = numeric, categorical, folds
        spread = rows.withColumn("f", F.explode(F.array_except(F.sequence(F.lit(0), F.lit(folds - 1)), F.array("fold"))))
        clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
        known = [x for i, c in enumerate(numeric) for x in (F.percentile(clean(c), quarters).alias(f"q{i}"), F.count(clean(c)).alias(f"k{i}"))]
        seen = [F.sort_array(F.collect_set(c)).alias(f"s{i}") for i, c in enumerate(categorical)]  # a few
        first = spread.groupBy("f").agg(F.count("*").alias("n"), *known, *seen).collect()
        self.middle = {r["f"]: [float(r[f"q{i}"][1]) if r[f"q{i}"] else 0.0 for i in range(len(numeric))] for r in first}
        self.gaps = {r["f"]: [r[f"k{i}"] < r["n"] for i in range(len(numeric))] for r in first}
        filled = {r["f"]: [r[f"q{i}"] for i in range(len(numeric))] for r in first}
        # Imputed rows move the quartiles of the columns with gaps only.
        holed = [i for i in range(len(numeric)) if any(g[i] for g in self.gaps.values())]
        fill = lambda i, c: F.coalesce(clean(c), F.element_at(F.create_map(*[F.lit(x) for f, m in self.middle.items() for x in (f, m[i])]), F.col("f")))
        if holed:
            for r in spread.groupBy("f").agg(*[F.percentile(fill(i, numeric[i]), quarters).alias(f"q{i}") for i in holed]).collect():
                for i in holed:
                    filled[r["f"]][i] = r[f"q{i}"]
        self.spread = {f: [(q[1], (q[2] - q[0]) or 1.0) for q in qs] for f, qs in filled.items()}
        self.levels: dict[tuple[int, str], list] = {(r["f"], c): r[f"s{i}"] for r in first for i, c in enumerate(categorical) if r[f"s{i}"]}

    def __call__(self, x: dict[str, np.ndarray], fold: int) -> np.ndarray:
        out = []
        for i, c in enumerate(self.numeric):
            if self.gaps[fold][i]:
                out.append(np.isnan(x[c]).astype(float))
            middle, scale = self.spread[fold][i]
            out.append((np.where(np.isnan(x[c]), self.middle[fold][i], x[c]) - middle) / scale)
        for c in self.categorical:
            out += [(x[c] == v).astype(float) for v in self.levels.get((fold, c), [])]
        n = len(next(iter(x.values())))
        return np.column_stack(out) if out else np.zeros((n, 0))


def _fold_rows(df: DataFrame, group: str, folds: int, columns: list[str]) -> DataFrame:
    columns = list(dict.fromkeys(columns))
    return staged(group_folds(df, group, folds).select("fold", *columns), "folds")


def ridge_from(gram: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients and an intercept that isn't penalised, from the cross products of (1, x, y)."""
    n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
    c = gram[1:, 1:] - n * np.outer(mean, mean)
    beta = np.linalg.solve(c[:-1, :-1] + alpha * np.eye(len(c) - 1), c[:-1, -1])
    return beta, float(mean[-1] - mean[:-1] @ beta)


def grouped_ridge(df: DataFrame, target: str, numeric: list[str], categorical: list[str] | None = None, group: str = "participant_id", folds: int = 5, alpha: float = 1.0) -> DataFrame:
    """Out-of-fold R2, MAE and RMSE of a ridge regression with folds by group: one row.

    A fold's fit needs the cross products of its training rows only: one pass adds them up for all folds, a second one the errors.
    """
    categorical = categorical or []
    rows = _fold_rows(df.filter(F.col(target).isNotNull()), group, folds, [target, *numeric, *categorical])
    columns = rows.columns
    design = FoldDesign(rows, numeric, categorical, folds)
    live = sorted(design.spread)

    def products(x: dict[str, np.ndarray]) -> np.ndarray:
        out = []
        for f in live:
            z = np.column_stack([np.ones(len(x["fold"])), design(x, f), x[target]])[x["fold"] != f]
            out.append((z.T @ z).ravel())
        return np.concatenate(out)

    total, fits, at = summed(rows, columns, products) if live else None, {}, 0
    if total is not None:
        for f in live:
            p = 2 + sum(1 + g for g in design.gaps[f]) + sum(len(design.levels.get((f, c), [])) for c in categorical)
            fits[f] = ridge_from(total[at : at + p * p].reshape(p, p), alpha)
            at += p * p

    def errors(x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.zeros(5)
        for f, (beta, bias) in fits.items():
            mine = x["fold"] == f
            y = x[target][mine]
            e = y - design({c: v[mine] for c, v in x.items()}, f) @ beta - bias
            out += [len(y), (e**2).sum(), np.abs(e).sum(), y.sum(), (y**2).sum()]
        return out

    e = summed(rows, columns, errors) if fits else None
    n, squares, gaps, s, ss = e if e is not None else np.zeros(5)
    around = ss - s * s / n if n else 0.0
    row = (int(n), float(1 - squares / around) if around > 0 else None, float(gaps / n) if n else None, float(np.sqrt(squares / n)) if n else None)
    return df.sparkSession.createDataFrame([row], "n long, r2 double, mae double, rmse double")


def grouped_ridge_models(
    df: DataFrame, targets: list[str], sets: dict[str, tuple[list[str], list[str]]], group: str = "participant_id", folds: int = 5, alpha: float = 1.0, *, present: float | None = None
) -> DataFrame:
    """A row for each target and model of ``sets`` (numeric and categorical features): status, reason, n_windows, n_subjects, folds, r2, mae, rmse out of fold, and the features used.

    Folds are by group.  All models of a target share one design: the cross products of all features are added up once, and a model takes its rows and columns of them.  A target needs two
    groups, and 20 rows or four a fold; a model without features predicts the training mean; with ``present`` a feature is used where so large a share of the target's rows has it.
    """
    spark = df.sparkSession
    numeric, categorical = (list(dict.fromkeys(c for s in sets.values() for c in s[i])) for i in (0, 1))
    out: list[tuple] = []
    for target in targets:
        rows = _fold_rows(df.filter(F.col(target).isNotNull() & F.col(group).isNotNull()), group, folds, [group, target, *numeric, *categorical])
        known = rows.agg(F.count("*").alias("n"), F.count_distinct(group).alias("g"), *[F.avg(F.col(c).isNotNull().cast("double")).alias(f"p{i}") for i, c in enumerate(numeric)]).first()
        n, groups = known["n"], known["g"]
        splits = min(folds, groups)
        shares = {c: known[f"p{i}"] or 0.0 for i, c in enumerate(numeric)}
        used = {m: ([c for c in a if c != target and (shares[c] > 0 if present is None else shares[c] >= present)], [c for c in b if c != target]) for m, (a, b) in sets.items()}
        told = {m: ("|".join(a), "|".join(b)) for m, (a, b) in used.items()}
        if splits < 2 or n < max(20, 4 * splits):
            out += [(target, m, "not_testable", "insufficient rows or participant groups", n, groups, splits, None, None, None, *told[m]) for m in sets]
            continue
        design = FoldDesign(rows, numeric, categorical, folds)
        live = sorted(design.spread)
        columns = [c for c in rows.columns if c != group or c in numeric or c in categorical]
        at: dict[tuple[int, str], list[int]] = {}
        width = {}
        for f in live:
            k = 1
            for i, c in enumerate(numeric):
                at[f, c] = list(range(k, k + 1 + design.gaps[f][i]))
                k += 1 + design.gaps[f][i]
            for c in categorical:
                at[f, c] = list(range(k, k + len(design.levels.get((f, c), []))))
                k += len(at[f, c])
            width[f] = k + 1

        def products(x: dict[str, np.ndarray], design=design, live=live, target=target) -> np.ndarray:
            parts = []
            for f in live:
                z = np.column_stack([np.ones(len(x["fold"])), design(x, f), x[target]])[x["fold"] != f]
                parts.append((z.T @ z).ravel())
            return np.concatenate(parts)

        total, fits, k = summed(rows, columns, products), {}, 0
        for f in live:
            gram = total[k : k + width[f] ** 2].reshape(width[f], width[f])
            k += width[f] ** 2
            for m, (a, b) in used.items():
                pick = [0, *[j for c in (*a, *b) for j in at[f, c]], width[f] - 1]
                fits[m, f] = (pick[1:-1], *ridge_from(gram[np.ix_(pick, pick)], alpha))

        def errors(x: dict[str, np.ndarray], design=design, live=live, target=target, fits=fits) -> np.ndarray:
            parts = {m: np.zeros(5) for m in sets}
            for f in live:
                mine = x["fold"] == f
                y = x[target][mine]
                z = np.column_stack([np.ones(len(y)), design({c: v[mine] for c, v in x.items()}, f)])
                for m in sets:
                    pick, beta, bias = fits[m, f]
                    e = y - z[:, pick] @ beta - bias
                    parts[m] += [len(y), (e**2).sum(), np.abs(e).sum(), y.sum(), (y**2).sum()]
            return np.concatenate([parts[m] for m in sets])

        found = summed(rows, columns, errors).reshape(len(sets), 5)
        for m, (count, square, size, y, yy) in zip(sets, found.tolist(), strict=True):
            around = yy - y * y / count
            out.append((target, m, "ok", None, n, groups, splits, 1 - square / around if around > 0 else None, size / count, math.sqrt(square / count), *told[m]))
    return spark.createDataFrame(out, "target string, model string, status string, reason string, n_windows long, n_subjects long, folds int, r2 double, mae double, rmse double, numeric_features string, categorical_features string")


def gains(models: DataFrame, **against: str) -> DataFrame:
    """``models`` of :func:`grouped_ridge_models` with a column ``delta_r2_vs_<name>`` for each model to compare with."""
    for name, model in against.items():
        base = models.filter(F.col("model") == model).select("target", F.col("r2").alias("base"))
        models = models.join(base, "target", "left").withColumn(f"delta_r2_vs_{name}", F.col("r2") - F.col("base")).drop("base")
    return models


def logistic_fit(x: np.ndarray, y: np.ndarray, classes: int, weight: np.ndarray, l2: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Multinomial coefficients (with an intercept in the last row) by Newton's method on each class in turn (bound optimisation)."""
    z = np.column_stack([x, np.ones(len(x))])
    b = np.zeros((z.shape[1], classes))
    penalty = l2 * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-6
    hess = np.linalg.inv(0.5 * (1 - 1 / classes) * (z * weight[:, None]).T @ z + penalty) if classes > 1 else None
    target = np.eye(classes)[y]
    for _ in range(rounds):
        p = softmax(z @ b)
        step = hess @ (z.T @ (weight[:, None] * (target - p)) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


def softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def grouped_classification(df: DataFrame, label: str, numeric: list[str], group: str = "participant_id", folds: int = 5, l2: float = 1.0, rounds: int = 60) -> DataFrame:
    """Out-of-fold class probabilities with balanced weights: group, truth, predicted, confidence, log_loss.

    The multinomial fits of all folds share the passes: each adds up the gradients of all folds, a step is by a fixed bound of the Hessian, which is a sum as well.
    """
    names = sorted(r[0] for r in df.select(label).filter(F.col(label).isNotNull()).distinct().collect())
    rows = _fold_rows(df.filter(F.col(label).isNotNull()), group, folds, [group, label, *numeric])
    columns, classes = ["fold", label, *numeric], len(names)
    design = FoldDesign(rows, numeric, [], folds)
    counts: dict[int, np.ndarray] = {f: np.zeros(classes) for f in design.spread}
    for r in rows.groupBy("fold", label).agg(F.count("*").alias("n")).collect():  # folds by labels
        for f, c in counts.items():
            c[names.index(r[label])] += r["n"] * (r["fold"] != f)
    weights = {f: c.sum() / (np.count_nonzero(c) * np.maximum(c, 1)) for f, c in counts.items()}
    place = {v: i for i, v in enumerate(names)}
    width = {f: 1 + sum(1 + g for g in design.gaps[f]) for f in design.spread}
    coefficients = {f: np.zeros((width[f], classes)) for f in design.spread}

    def training(x: dict[str, np.ndarray], f: int):
        on = x["fold"] != f
        z = np.column_stack([design({c: v[on] for c, v in x.items()}, f), np.ones(int(on.sum()))])
        y = np.array([place[v] for v in x[label][on]], dtype=int)
        return z, y, weights[f][y]

    def bounds(x: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([((z * w[:, None]).T @ z).ravel() for z, _, w in (training(x, f) for f in coefficients)])

    total = summed(rows, columns, bounds) if coefficients else None
    at, inverse, penalty = 0, {}, {}
    for f in coefficients if total is not None else ():
        k = width[f]
        penalty[f] = l2 * np.eye(k)
        penalty[f][-1, -1] = 1e-6
        inverse[f] = np.linalg.inv(0.5 * (1 - 1 / max(classes, 2)) * total[at : at + k * k].reshape(k, k) + penalty[f])
        at += k * k
    live = list(inverse)
    for _ in range(rounds):

        def gradients(x: dict[str, np.ndarray], live=tuple(live)) -> np.ndarray:
            out = []
            for f in live:
                z, y, w = training(x, f)
                out.append((z.T @ (w[:, None] * (np.eye(classes)[y] - softmax(z @ coefficients[f])))).ravel())
            return np.concatenate(out)

        if not live:
            break
        total, at, still = summed(rows, columns, gradients), 0, []
        for f in live:
            k = width[f] * classes
            step = inverse[f] @ (total[at : at + k].reshape(-1, classes) - penalty[f] @ coefficients[f])
            coefficients[f] = coefficients[f] + step
            at += k
            if np.abs(step).max() >= 1e-6:
                still.append(f)
        live = still
    texts = rows.schema[label].dataType.simpleString() == "string"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = b.column(0).to_numpy(zero_copy_only=False)
            x = {c: v.cast(pa.float64()).to_numpy(zero_copy_only=False) for c, v in zip(numeric, b.columns[3:], strict=True)}
            truth = np.array([place[v] for v in b.column(2).to_pylist()], dtype=int)
            p = np.full((b.num_rows, classes), 1 / max(classes, 1))
            for f in inverse:
                on = fold == f
                if on.any():
                    p[on] = softmax(np.column_stack([design({c: v[on] for c, v in x.items()}, f), np.ones(int(on.sum()))]) @ coefficients[f])
            own = p[np.arange(len(truth)), truth] if len(truth) else np.zeros(0)
            word = lambda i: names[i] if texts else str(names[i])
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.array([word(i) for i in truth], pa.string()), pa.array([word(i) for i in p.argmax(axis=1)] if len(truth) else [], pa.string()), pa.array(p.max(axis=1) if len(truth) else [], pa.float64()), pa.array(-np.log(np.maximum(own, 1e-15)), pa.float64())],
                names=[group, "truth", "predicted", "confidence", "log_loss"],
            )

    kind = df.schema[group].dataType.simpleString()
    return rows.select("fold", group, label, *numeric).mapInArrow(score, f"{group} {kind}, truth string, predicted string, confidence double, log_loss double")


def dealt_labels(place: np.ndarray, counts: np.ndarray, repetitions: int, seed: int = 42) -> np.ndarray:
    """Labels (places by repetitions) of the groups numbered ``place`` under random permutations of all labels: each repetition deals label k to ``counts[k]`` groups exactly.

    A permutation is a small cipher of the numbers below the number of groups, so a group's label is had where the group is read, without the others.
    """
    n = int(counts.sum())
    half = max(1, -(-(max(n, 2) - 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    rng = np.random.default_rng(seed)
    keys = rng.integers(0, 2**63, (repetitions, 6), dtype=np.uint64)
    edges = np.cumsum(counts)
    out = np.zeros((len(place), repetitions), np.int16)
    with np.errstate(over="ignore"):
        for r in range(repetitions):
            v = place.astype(np.uint64)
            todo = np.arange(len(v))
            while len(todo):
                a, b = v[todo] >> np.uint64(half), v[todo] & mask
                for k in keys[r]:
                    m = (b + k) * np.uint64(0x9E3779B97F4A7C15)
                    m = (m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    a, b = b, a ^ ((m >> np.uint64(32)) & mask)
                v[todo] = (a << np.uint64(half)) | b
                todo = todo[v[todo] >= n]  # the cipher is of a power of two: walk on to a number below n
            out[:, r] = np.searchsorted(edges, v.astype(np.int64), side="right")
    return out


def dense_places(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """``df`` with the number of each row from 0 in ``order``: sorted by ranges, with the rows before each range added."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = staged(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), "places")
    part = F.shiftright("__m", 33)
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row a partition
    before, start = 0, []
    for p, n in sizes:
        start += [F.lit(p), F.lit(before)]
        before += n
    offset = F.create_map(*start)[part] if start else F.lit(0)
    return placed.withColumn(name, (F.col("__m").bitwiseAND((1 << 33) - 1) + offset).cast("long")).drop("__m")


def permuted_accuracy(df: DataFrame, label: str, numeric: list[str], group: str, repetitions: int = 100, folds: int = 5, l2: float = 1.0, rounds: int = 40, seed: int = 42) -> DataFrame:
    """(replicate, balanced_accuracy) of out-of-fold predictions with the labels of whole groups permuted.

    All replicates and folds are fitted together: each pass over the rows adds up their gradients and curvatures, and a row carries its group's labels of all replicates.
    """
    spark = df.sparkSession
    usable = df.filter(F.col(label).isNotNull() & F.col(group).isNotNull())
    groups = dense_places(usable.groupBy(group).agg(F.min(label).alias("l")), ["l", group])
    counted = sorted((r["l"], r["n"]) for r in groups.groupBy("l").agg(F.count("*").alias("n")).collect())  # a row a class
    counts = np.array([n for _, n in counted], np.int64)
    classes, every = len(counts), repetitions
    if classes < 2:
        return spark.createDataFrame([], "replicate int, balanced_accuracy double")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dealt = dealt_labels(b.column(1).to_numpy(), counts, every, seed).astype(np.uint8 if classes < 256 else np.int16)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in dealt], pa.binary())], names=["__g", "dealt"])

    kind = groups.schema[group].dataType.simpleString()
    carried = groups.select(group, "place").mapInArrow(deal, f"__g {kind}, dealt binary")
    rows = staged(group_folds(usable, group, folds).join(carried, F.col(group) == F.col("__g")).select("fold", *numeric, "dealt"), "permuted")
    design = FoldDesign(rows, numeric, [], folds)
    live = sorted(design.spread)
    width = {f: 1 + sum(1 + g for g in design.gaps[f]) for f in live}

    def passed(of: Callable[[np.ndarray, dict[str, np.ndarray], np.ndarray], np.ndarray]) -> np.ndarray | None:
        """The sum of ``of(fold, features, labels by replicate)`` over all rows, some thousands at a time."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for lo in range(0, b.num_rows, 2048):
                    c = b.slice(lo, 2048)
                    x = {name: v.cast(pa.float64()).to_numpy(zero_copy_only=False) for name, v in zip(numeric, c.columns[1:-1], strict=True)}
                    y = np.stack([np.frombuffer(v, np.uint8 if classes < 256 else np.int16) for v in c.column(c.num_columns - 1).to_pylist()]).astype(np.int64)
                    v = of(c.column(0).to_numpy(zero_copy_only=False), x, y)
                    total = v if total is None else total + v
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

        found = [np.array(r["v"]) for r in rows.mapInArrow(part, "v array<double>").collect()]
        return sum(found[1:], found[0]) if found else None

    def inputs(fold: np.ndarray, x: dict[str, np.ndarray], f: int, train: bool) -> tuple[np.ndarray, np.ndarray]:
        on = np.flatnonzero((fold != f) if train else (fold == f))
        return on, np.column_stack([design({c: v[on] for c, v in x.items()}, f), np.ones(len(on))])

    def sizes(fold: np.ndarray, x: dict[str, np.ndarray], y: np.ndarray) -> np.ndarray:
        hot = np.stack([(y == c) for c in range(classes)], axis=2)
        return np.stack([hot[fold != f].sum(axis=0) for f in live]).astype(float).ravel()

    total = passed(sizes)
    if total is None:
        return spark.createDataFrame([], "replicate int, balanced_accuracy double")
    n = total.reshape(len(live), every, classes)
    weights = np.where(n > 0, n.sum(axis=2, keepdims=True) / (np.maximum((n > 0).sum(axis=2, keepdims=True), 1) * np.maximum(n, 1)), 0.0)
    beta = {f: np.zeros((every, width[f], classes)) for f in live}
    moving = {f: np.arange(every) for f in live}
    ridge = {f: np.repeat(np.append(np.full(width[f] - 1, l2), 1e-6), classes) for f in live}
    for _ in range(rounds):
        todo = [f for f in live if len(moving[f])]
        if not todo:
            break

        def steps(fold: np.ndarray, x: dict[str, np.ndarray], y: np.ndarray, todo=tuple(todo)) -> np.ndarray:
            out = []
            for f in todo:
                on, z = inputs(fold, x, f, True)
                r, k = moving[f], width[f]
                yr = y[np.ix_(on, r)]
                w = np.take_along_axis(weights[live.index(f)][r], yr.T, axis=1).T if len(on) else np.zeros((0, len(r)))
                p = softmax(np.einsum("nk,rkc->nrc", z, beta[f][r], optimize=True))
                gradient = np.einsum("nk,nrc->rkc", z, w[..., None] * (np.eye(classes)[yr] - p), optimize=True)
                square = (z[:, :, None] * z[:, None, :]).reshape(len(on), k * k)
                curve = np.zeros((len(r), k, classes, k, classes))
                for c in range(classes):
                    for d in range(c, classes):
                        part = ((w * p[..., c] * ((c == d) - p[..., d])).T @ square).reshape(len(r), k, k)
                        curve[:, :, c, :, d] = part
                        curve[:, :, d, :, c] = part
                out += [gradient.ravel(), curve.ravel()]
            return np.concatenate(out)

        total, at = passed(steps), 0
        for f in todo:
            r, k = moving[f], width[f] * classes
            gradient = total[at : at + len(r) * k].reshape(len(r), k) - ridge[f] * beta[f][r].reshape(len(r), k)
            at += len(r) * k
            curve = total[at : at + len(r) * k * k].reshape(len(r), k, k) + np.diag(ridge[f])
            at += len(r) * k * k
            step = np.linalg.solve(curve, gradient[..., None])[..., 0]
            size = np.abs(step).max(axis=1)
            step *= np.minimum(1.0, 3.0 / np.maximum(size, 1e-300))[:, None]  # far from the optimum, not too far at once
            beta[f][r] += step.reshape(len(r), width[f], classes)
            moving[f] = r[size >= 1e-6]

    def hits(fold: np.ndarray, x: dict[str, np.ndarray], y: np.ndarray) -> np.ndarray:
        right, seen = np.zeros((every, classes)), np.zeros((every, classes))
        for f in live:
            on, z = inputs(fold, x, f, False)
            found = np.einsum("nk,rkc->nrc", z, beta[f], optimize=True).argmax(axis=2)
            for c in range(classes):
                mine = y[on] == c
                seen[:, c] += mine.sum(axis=0)
                right[:, c] += (mine & (found == c)).sum(axis=0)
        return np.concatenate([right.ravel(), seen.ravel()])

    right, seen = passed(hits).reshape(2, every, classes)
    score = np.nanmean(np.where(seen > 0, right / np.maximum(seen, 1), np.nan), axis=1)
    return spark.createDataFrame([(r, float(v)) for r, v in enumerate(score)], "replicate int, balanced_accuracy double")


def classification_metrics(out: DataFrame, confident: float = 0.6) -> DataFrame:
    """Accuracy, balanced accuracy, macro F1, log loss and the share of confident rows."""
    t = out.groupBy("truth").agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("recall"))
    p = out.groupBy(F.col("predicted").alias("truth")).agg(F.count("*").alias("m"), F.sum((F.col("truth") == F.col("predicted")).cast("int")).alias("hit"))
    by = t.join(p, "truth", "left").withColumn("f1", safe_div(2 * F.coalesce("hit", F.lit(0)), F.col("n") + F.coalesce("m", F.lit(0))))
    one = by.agg(F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"))
    rest = out.agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("accuracy"), F.avg("log_loss").alias("log_loss"), F.avg((F.col("confidence") >= confident).cast("double")).alias("confident_share"))
    return rest.join(one, F.lit(True))


def pls(gram: np.ndarray, p: int, components: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, x means, y means and y spreads of partial least squares (two blocks, deflated, on standardised columns), from the cross products of (1, x, y)."""
    n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
    c = gram[1:, 1:] - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(c), 0) / max(n - 1, 1))
    sd = np.where(sd > 1e-12, sd, 1)
    c = c / np.outer(sd, sd)
    a, b = c[:p, :p].copy(), c[:p, p:].copy()  # of x with x, and x with y
    ws, ps, qs = [], [], []
    for _ in range(min(components, p)):
        w = np.linalg.svd(b, full_matrices=False)[0][:, 0]
        tt = w @ a @ w
        if tt <= 1e-12:
            break
        left, right = a @ w / tt, b.T @ w / tt
        a, b = a - tt * np.outer(left, left), b - tt * np.outer(left, right)
        ws.append(w), ps.append(left), qs.append(right)
    if not ws:
        return np.zeros((p, len(mean) - p)), mean[:p], mean[p:], sd[p:]
    w, left, right = (np.column_stack(v) for v in (ws, ps, qs))
    return (w @ np.linalg.pinv(left.T @ w) @ right.T) / sd[:p, None] * sd[p:], mean[:p], mean[p:], sd[p:]


def grouped_pls(df: DataFrame, left: list[str], right: list[str], group: str, folds: int = 5, parts: int = 2) -> DataFrame:
    """Out-of-fold share of the variance of ``right`` that ``left`` explains: one row; from the cross products of each fold's training rows."""
    rows = _fold_rows(df.dropna(subset=[*left, *right]), group, folds, [*left, *right])
    columns, p, k = rows.columns, len(left), 1 + len(left) + len(right)
    block = lambda x: np.column_stack([np.ones(len(x["fold"])), *[x[c] for c in (*left, *right)]])

    def products(x: dict[str, np.ndarray]) -> np.ndarray:
        z = block(x)
        return np.concatenate([(z[x["fold"] != f].T @ z[x["fold"] != f]).ravel() for f in range(folds)])

    total = summed(rows, columns, products)
    grams = total.reshape(folds, k, k) if total is not None else []
    fits = {f: pls(g, p, parts) for f, g in enumerate(grams) if g[0, 0] >= 3}

    def errors(x: dict[str, np.ndarray]) -> np.ndarray:
        out, z = np.zeros(3), block(x)
        for f, (beta, mx, my, sd) in fits.items():
            mine = z[x["fold"] == f]
            y = mine[:, 1 + p :]
            out += [len(y), (((y - my - (mine[:, 1 : 1 + p] - mx) @ beta) / sd) ** 2).sum(), (((y - my) / sd) ** 2).sum()]
        return out

    e = summed(rows, columns, errors) if fits else None
    n, rest, around = e if e is not None else np.zeros(3)
    return df.sparkSession.createDataFrame([(int(n), float(1 - rest / around) if around > 0 else None)], "n long, r2 double")


def factor_analysis(cov: np.ndarray, k: int, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Loadings and noise variances of a maximum-likelihood factor model, by expectation-maximisation from the covariance alone."""
    value, vector = np.linalg.eigh(cov)
    load = vector[:, ::-1][:, :k] * np.sqrt(np.maximum(value[::-1][:k], 1e-12) / 2)
    noise = np.maximum(np.diag(cov) / 2, 1e-12)
    for _ in range(rounds):
        beta = np.linalg.solve(load @ load.T + np.diag(noise), load).T
        load = cov @ beta.T @ np.linalg.inv(np.eye(k) - beta @ load + beta @ cov @ beta.T)
        new = np.maximum(np.diag(cov - load @ beta @ cov), 1e-12)
        if np.abs(new - noise).max() < 1e-8:
            break
        noise = new
    return load, noise


def gaussian_log_likelihood(mean: np.ndarray, cov: np.ndarray, test_mean: np.ndarray, test_cov: np.ndarray) -> float:
    """Mean log density of rows of which only mean and covariance are known."""
    gap = test_mean - mean
    _, logdet = np.linalg.slogdet(cov)
    return float(-0.5 * (np.trace(np.linalg.solve(cov, test_cov + np.outer(gap, gap))) + logdet + len(mean) * math.log(2 * math.pi)))


def silhouette(x: np.ndarray, labels: np.ndarray) -> float | None:
    """Mean silhouette by Euclidean distance of a matrix of rows."""
    names = np.unique(labels)
    if len(names) < 2:
        return None
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0))
    sums = np.stack([d[:, labels == c].sum(axis=1) for c in names], axis=1)
    sizes = np.array([(labels == c).sum() for c in names])
    own = np.searchsorted(names, labels)
    i = np.arange(len(x))
    a = sums[i, own] / np.maximum(sizes[own] - 1, 1)
    mean = sums / sizes
    mean[i, own] = np.inf
    b = mean.min(axis=1)
    return float(np.where(sizes[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0).mean())


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns of one length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return safe_div(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
