"""Order-sensitive features of a series: native where a window function says it, Arrow batches where it doesn't."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trialweave.functions.columns import correlation, interpolated, safe_div, slope
from trialweave.plans.staging import staged


def series(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, i, x: the finite values of each key in order, numbered from 0."""
    rows = df.select(key, order, F.col(value).cast("double").alias("x")).filter("x is not null and not isnan(x)")
    return rows.select(key, (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long").alias("i"), "x")


def _ordered(s: DataFrame, key: str):
    return Window.partitionBy(key).orderBy("i")


def lag_correlations(s: DataFrame, key: str, lags: tuple[int, ...] = (1, 2)) -> DataFrame:
    w = _ordered(s, key)
    rows = s.withColumns({f"l{k}": F.lag("x", k).over(w) for k in lags})
    # n > k + 2 values leave n - k >= 3 pairs
    return rows.groupBy(key).agg(*[correlation(F.col("x"), F.col(f"l{k}"), 3).alias(f"lag{k}") for k in lags])


def spread_features(s: DataFrame, key: str) -> DataFrame:
    """Roughness, SD1/SD2 ratio, sign-change rate, slope over position."""
    w = _ordered(s, key)
    steps = s.withColumn("d", F.col("x") - F.lag("x").over(w))
    signs = steps.filter("d <> 0").withColumn("sign", F.signum("d"))
    signs = signs.withColumn("turn", (F.col("sign") != F.lag("sign").over(w)).cast("double"))
    turns = signs.groupBy(key).agg(F.when(F.count("*") >= 2, F.avg("turn")).alias("sign_change"))
    base = steps.groupBy(key).agg(F.count("x").alias("n"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmssd"), F.stddev_samp("x").alias("sd"), slope(F.col("x"), F.col("i").cast("double")).alias("slope"))
    sd2 = 2 * F.col("sd") * F.col("sd") - 0.5 * F.col("rmssd") * F.col("rmssd")
    out = base.withColumns({
        "roughness": F.when(F.col("n") >= 3, safe_div(F.col("rmssd"), F.col("sd"))),
        "sd1_sd2": F.when((F.col("n") >= 3) & (sd2 > 0), F.col("rmssd") / F.sqrt(F.lit(2.0)) / F.sqrt(sd2)),
    })
    return out.join(turns, key, "left").select(key, "n", "roughness", "sd1_sd2", "sign_change", "slope")


def permutation_entropy(s: DataFrame, key: str) -> DataFrame:
    """Normalised entropy of the order patterns of three neighbours; ties by position; from 5 values on."""
    w = _ordered(s, key)
    x, y, z = F.col("x"), F.lead("x", 1).over(w), F.lead("x", 2).over(w)
    rows = s.select(key, x.alias("a"), y.alias("b"), z.alias("c")).filter("c is not null")
    code = (F.col("a") <= F.col("b")).cast("int") * 4 + (F.col("b") <= F.col("c")).cast("int") * 2 + (F.col("a") <= F.col("c")).cast("int")
    counts = rows.groupBy(key, code.alias("pattern")).agg(F.count("*").alias("k"))
    return entropy(counts, [key], 6.0).filter("n >= 3").select(key, F.col("h").alias("perm_entropy3"))


def entropy(counts: DataFrame, keys: list[str], base: float) -> DataFrame:
    """keys, n, h: entropy of the counts k of each key, in units of ln base."""
    w = Window.partitionBy(*keys)
    p = F.col("k") / F.sum("k").over(w)
    return counts.withColumn("p", p).groupBy(*keys).agg(F.sum("k").alias("n"), (-F.sum(F.col("p") * F.ln("p")) / math.log(base)).alias("h"))


def difference_entropy(s: DataFrame, key: str, bins: int = 16) -> DataFrame:
    """Normalised entropy of the steps, clipped at the 95th percentile of their size, over equal bins; from 4 steps on.

    Bins come from counting the edges at or below a value, as a histogram does.
    """
    w = _ordered(s, key)
    steps = s.withColumn("d", F.col("x") - F.lag("x").over(w)).filter("d is not null")
    steps = interpolated(steps, [key], F.abs("d"), 0.95, "c").filter("c > 0").withColumn("v", F.greatest(F.least("d", "c"), -F.col("c")))
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: -F.col("c") + i * (2 * F.col("c") / bins))
    index = F.least(F.size(F.filter(edges, lambda e: e <= F.col("v"))) - 1, F.lit(bins - 1))
    counts = steps.groupBy(key, F.greatest(index, F.lit(0)).alias("bin")).agg(F.count("*").alias("k"))
    return entropy(counts, [key], float(bins)).filter("n >= 4").select(key, F.col("h").alias("diff_entropy"))


def mutual_information(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Mutual information in bits of two discrete columns; NULL where one has a single class."""
    counts = pairs.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(key, left, right).agg(F.count("*").alias("k"))
    w = Window.partitionBy(key)
    n = F.sum("k").over(w)
    rows = counts.withColumns({"p": F.col("k") / n, "pl": F.sum("k").over(Window.partitionBy(key, left)) / n, "pr": F.sum("k").over(Window.partitionBy(key, right)) / n})
    ok = (F.count_distinct(left) >= 2) & (F.count_distinct(right) >= 2)
    return rows.groupBy(key).agg(F.when(ok, F.sum(F.col("p") * F.log2(F.col("p") / (F.col("pl") * F.col("pr"))))).alias("mi_bits"))


# --- what needs the whole series at once -----------------------------------------------------------------------------------------------------------------------------


def dfa_alpha(x: np.ndarray) -> float | None:
    """Scaling exponent of detrended fluctuations over scales 4..16 of at least 40 values."""
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    if len(x) < 40 or x.std() == 0:
        return None
    profile = np.cumsum(x - x.mean())
    logs = []
    for s in range(4, 17):
        m = len(profile) // s
        if m < 4:
            continue
        parts = profile[: m * s].reshape(m, s)
        t = np.arange(s) - (s - 1) / 2
        trend = parts.mean(axis=1, keepdims=True) + (parts @ t / (t @ t))[:, None] * t
        f = math.sqrt(((parts - trend) ** 2).mean())
        if f > 0:
            logs.append((math.log(s), math.log(f)))
    if len(logs) < 4:
        return None
    a, b = np.array(logs).T
    return float(((a - a.mean()) * (b - b.mean())).sum() / ((a - a.mean()) ** 2).sum())


def sample_entropy(x: np.ndarray, m: int = 2, fraction: float = 0.2) -> float | None:
    """-ln of the share of template matches that last one value more; from 20 values on."""
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    if len(x) < 20:
        return None
    r = fraction * x.std(ddof=1)
    if not r > 0:
        return None

    def pairs(k: int) -> int:
        t = np.lib.stride_tricks.sliding_window_view(x, k)
        near = np.ones((len(t), len(t)), bool)
        for j in range(k):
            near &= np.abs(t[:, j, None] - t[None, :, j]) <= r
        return (int(near.sum()) - len(t)) // 2

    a, b = pairs(m + 1), pairs(m)
    return -math.log(a / b) if a and b else None


def stable_seed(seed: int, *values: object) -> int:
    """A 32-bit seed that depends on nothing but its arguments."""
    digest = hashlib.sha256("|".join(map(str, (seed, *values))).encode()).digest()
    return int.from_bytes(digest[:8], "little") % (2**32 - 1)


def _mi_of_codes(i: np.ndarray, j: np.ndarray, rows: int, columns: int, share: np.ndarray) -> float:
    """Mutual information in bits of two columns of codes; ``share[k]`` is the probability of k rows."""
    p = share[np.bincount(i * columns + j, minlength=rows * columns)].reshape(rows, columns)
    q = p.sum(axis=1, keepdims=True) * p.sum(axis=0, keepdims=True)
    some = p > 0
    return float((p[some] * np.log2(p[some] / q[some])).sum())


def _shares(n: int) -> np.ndarray:
    """The probabilities of 0 to n rows of n, added up row by row."""
    return np.concatenate(([0.0], np.cumsum(np.full(n, 1 / n))))


def mi_bits(a: np.ndarray, b: np.ndarray) -> float | None:
    _, i = np.unique(a, return_inverse=True)
    _, j = np.unique(b, return_inverse=True)
    if not len(a) or i.max() == 0 or j.max() == 0:
        return None
    return _mi_of_codes(i, j, int(i.max()) + 1, int(j.max()) + 1, _shares(len(a)))


def corrected_mi(a: np.ndarray, b: np.ndarray, seed: int, *, least: int = 40, permutations: int = 50, least_class: int = 3) -> tuple[float | None, str | None]:
    """Mutual information less its mean under permutation, at least 0; else the reason it can't be had."""
    keep = ~(pd.isna(a) | pd.isna(b))
    a, b = np.asarray(a)[keep], np.asarray(b)[keep]
    if len(a) < least:
        return None, "insufficient_observations"
    codes = []
    for name, v in (("left", a), ("right", b)):
        _, code, n = np.unique(v, return_inverse=True, return_counts=True)
        if len(n) < 2:
            return None, f"invariant_{name}"
        if n.min() < least_class:
            return None, f"sparse_{name}_class"
        codes.append((code, len(n)))
    # Values are coded once: a permutation of them is the same permutation of their codes.
    (i, rows), (j, columns), share = *codes, _shares(len(a))
    observed = _mi_of_codes(i, j, rows, columns, share)
    rng = np.random.default_rng(seed)
    null = np.mean([_mi_of_codes(i, rng.permutation(j), rows, columns, share) for _ in range(permutations)])
    return max(0.0, observed - float(null)), None


#: A longer series is compared with itself by several tasks.
LONG = 20_000


def spread(x: np.ndarray) -> float:
    """Sample standard deviation by running means, in the order of the rows: where a tolerance made of it is exactly a difference of values, the last bit decides, and this is the one that DuckDB's stddev_samp has."""
    mean = squares = 0.0
    for n, v in enumerate(x.tolist(), 1):
        last, mean = mean, mean + (v - mean) / n
        squares += (v - mean) * (v - last)
    return math.sqrt(squares / (len(x) - 1))


def template_matches(x: np.ndarray, r: float, lo: int = 0, hi: int | None = None) -> tuple[int, int]:
    """Pairs of templates of two and of three values that are within r in each; of those whose lower first value has a place from lo to hi among all.

    Templates are sorted by their first value, so each is compared with those up to r above it only, some thousands at a time.
    """
    if len(x) < 2:
        return 0, 0
    order = np.argsort(x[:-1], kind="stable")
    a, b, c = x[order], x[order + 1], np.append(x[2:], np.nan)[order]
    top = np.searchsorted(a, a + r + 1e-9 * (np.abs(a) + r), side="right")  # the sum may round where the difference doesn't
    two = three = 0
    for p in range(lo, min(len(a), len(a) if hi is None else hi), 256):
        q = min(p + 256, len(a), len(a) if hi is None else hi)
        end = int(top[q - 1])
        for s in range(p, end, 4096):
            t = slice(s, min(s + 4096, end))
            near = (a[None, t] - a[p:q, None] <= r) & (np.abs(b[None, t] - b[p:q, None]) <= r)
            near &= np.arange(t.start, t.stop) > np.arange(p, q)[:, None]
            two += int(near.sum())
            i, j = np.nonzero(near)
            three += int((np.abs(c[p + i] - c[s + j]) <= r).sum())
    return two, three


def matched_templates(s: DataFrame, key: str, long: int = LONG) -> DataFrame:
    """key, n, two, three: :func:`template_matches` within a fifth of the spread, of each series (key, i, x) of two values or more."""
    kind = s.schema[key].dataType.simpleString()
    sorted_rows = s.select(key, "i", "x").repartition(key).sortWithinPartitions(key, "i")

    def one(k, x: np.ndarray) -> list[tuple]:
        r = 0.2 * spread(x) if len(x) > 1 else 0.0
        if len(x) < 2:
            return []
        if len(x) <= long:
            return [(k, len(x), *template_matches(x, r), None, None, None)]
        return [(k, len(x), None, None, lo, r, x.tobytes()) for lo in range(0, len(x), long)]

    names = ["k", "n", "two", "three", "lo", "r", "packed"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            keys, x = b.column(0).to_pylist(), b.column(2).to_numpy(zero_copy_only=False)
            cut = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
            out: list[tuple] = []
            for lo, hi in zip(cut, [*cut[1:], len(keys)], strict=True):
                if keys[lo] != now and parts:
                    out += one(now, np.concatenate(parts))
                    parts = []
                now = keys[lo]
                parts.append(x[lo:hi])
            if out:
                yield batch(out)
        if parts and (out := one(now, np.concatenate(parts))):
            yield batch(out)

    arrow = to_arrow_type(s.schema[key].dataType)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [arrow, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, n, _, _, lo, r, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield batch([(k, n, *template_matches(np.frombuffer(packed), r, lo, lo + long), None, None, None)])

    schema = f"k {kind}, n long, two long, three long, lo long, r double, packed binary"
    found = staged(sorted_rows.mapInArrow(split, schema), "templates")
    far = found.filter("packed is not null").repartition("k", "lo").mapInArrow(count, schema)
    out = found.filter("packed is null").unionAll(far)
    return out.groupBy(F.col("k").alias(key)).agg(F.max("n").alias("n"), F.sum("two").alias("two"), F.sum("three").alias("three"))


def sample_entropies(s: DataFrame, key: str, long: int = LONG) -> DataFrame:
    """key, sample_entropy: -ln of the share of template matches that last one value more; from 20 values on."""
    found = (F.col("n") >= 20) & (F.col("two") > 0) & (F.col("three") > 0)
    rows = s.groupBy(key).agg((F.max("x") > F.min("x")).alias("varies"))
    out = rows.join(matched_templates(s, key, long), key, "left")
    return out.select(key, F.when(found & F.col("varies"), -F.ln(F.col("three") / F.col("two"))).alias("sample_entropy"))


def fluctuation(s: DataFrame, key: str) -> DataFrame:
    """key, dfa_alpha: scaling exponent of the detrended fluctuations of each series (key, i, x) over scales 4..16, from 40 values on; sums by part of a series.

    A scale whose parts are all straight lines has no fluctuation: what rounding leaves of it (1e-12 of a part's variance, or of the profile's size) isn't one.
    """
    w = Window.partitionBy(key)
    rows = s.withColumns({"n": F.count(F.lit(1)).over(w), "sd": F.stddev_pop("x").over(w), "d": F.col("x") - F.avg("x").over(w)}).filter("n >= 40 and sd > 0")
    rows = rows.withColumn("y", F.sum("d").over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).select(key, "i", "y", "n", F.explode(F.sequence(F.lit(4), F.lit(16))).alias("s"))
    whole = F.floor(F.col("n") / F.col("s"))
    parts = rows.filter((whole >= 4) & (F.col("i") < whole * F.col("s"))).groupBy(key, "s", F.floor(F.col("i") / F.col("s")).alias("part"))
    i = F.col("i").cast("double")
    rest = F.var_pop("y") - F.pow(F.covar_pop("y", i), F.lit(2.0)) / F.var_pop(i)
    sums = parts.agg(F.when(rest > 1e-12 * F.var_pop("y"), F.count("*") * rest).otherwise(F.lit(0.0)).alias("sse"), F.max(F.abs("y")).alias("size"))
    each = sums.groupBy(key, "s").agg(F.sqrt(F.sum("sse") / (F.count("*") * F.col("s"))).alias("f"), F.max("size").alias("size")).filter("f > 1e-12 * size")
    return each.groupBy(key).agg(F.when(F.count("*") >= 4, slope(F.ln("f"), F.ln(F.col("s").cast("double")))).alias("dfa_alpha"))


def range_entropy(s: DataFrame, key: str, bins: int = 12, least: int = 10) -> DataFrame:
    """key, diff_entropy: normalised entropy of the steps over equal bins of their range."""
    w = Window.partitionBy(key)
    steps = s.withColumn("d", F.col("x") - F.lag("x").over(w.orderBy("i"))).filter("d is not null").withColumns({"lo": F.min("d").over(w), "hi": F.max("d").over(w)}).filter("hi > lo")
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda e: F.col("lo") + e * ((F.col("hi") - F.col("lo")) / bins))
    index = F.greatest(F.least(F.size(F.filter(edges, lambda e: e <= F.col("d"))) - 1, F.lit(bins - 1)), F.lit(0))
    counts = steps.groupBy(key, index.alias("bin")).agg(F.count("*").alias("k"))
    return entropy(counts, [key], float(bins)).filter(F.col("n") >= least).select(key, F.col("h").alias("diff_entropy"))


def corrected_mi_by(df: DataFrame, key: str, order: str, left: str, right: str, seed: int = 42, **rules) -> DataFrame:
    """Corrected mutual information of each key with its reason."""

    def features(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        value, reason = corrected_mi(pdf[left].to_numpy(object), pdf[right].to_numpy(object), stable_seed(seed, pdf[key].iloc[0]), **rules)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "mi": pd.array([value], "Float64"), "missing_reason_mi": pd.array([reason], "string")})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, order, left, right).groupBy(key).applyInPandas(features, f"{key} {kind}, mi double, missing_reason_mi string")


def binned_mi(df: DataFrame, key: str, order: str, condition: str, value: str, seed: int = 42, bins: tuple[int, ...] = (3, 4, 5), **rules) -> DataFrame:
    """Median corrected information of a condition and a measure cut at its quantiles; else the most common reason."""

    def features(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf[value].to_numpy(float)
        values, reasons = [], []
        for k in bins:
            edges = np.unique(np.nanquantile(x, np.linspace(0, 1, k + 1))) if np.isfinite(x).any() else np.zeros(0)
            cut = np.where(np.isfinite(x), np.clip(np.searchsorted(edges, x, side="left"), 1, max(len(edges) - 1, 1)), np.nan)
            v, reason = corrected_mi(pdf[condition].to_numpy(object), pd.Series(cut).to_numpy(object), stable_seed(seed, pdf[key].iloc[0], k), **rules)
            values += [] if v is None else [v]
            reasons += [reason] if reason else []
        reason = None if values else max(sorted(set(reasons)), key=reasons.count)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "mi": pd.array([float(np.median(values)) if values else None], "Float64"), "missing_reason_mi": pd.array([reason], "string")})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, order, condition, value).groupBy(key).applyInPandas(features, f"{key} {kind}, mi double, missing_reason_mi string")
