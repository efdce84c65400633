"""Column helpers with the library's missing-value rule: NULL is the only missing value."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType


def null_nan(x: Column) -> Column:
    """NaN as NULL."""
    return F.when(~F.isnan(x), x)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def flag(cond: Column) -> Column:
    """The condition; NULL counts as false."""
    return F.coalesce(cond, F.lit(False))


def clip(x: Column, lo: float, hi: float) -> Column:
    """x within [lo, hi]; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))


def row_mean(cols: list[Column], least: int = 1) -> Column:
    """Mean of the non-null columns of a row, NULL below ``least`` of them."""
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])
    return F.when(n >= least, total / F.nullif(n, F.lit(0)))


def row_rms(cols: list[Column], least: int = 1) -> Column:
    """Root mean square of the non-null columns of a row."""
    return F.sqrt(row_mean([c * c for c in cols], least))


def mean_where(x: Column, cond: Column) -> Column:
    return F.avg(F.when(cond, x))


def count_where(cond: Column) -> Column:
    return F.count_if(flag(cond)).cast("long")


def slope(y: Column, x: Column, least: int = 3) -> Column:
    """Least-squares slope of y on x over rows with both, NULL under ``least`` rows or without spread."""
    both = y.isNotNull() & x.isNotNull()
    return F.when((F.count(F.when(both, 1)) >= least) & (F.max(F.when(both, x)) > F.min(F.when(both, x))), F.regr_slope(y, x))


def correlation(x: Column, y: Column, least: int) -> Column:
    """Pearson correlation over rows with both; NULL under ``least`` rows or where a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    n = F.count(F.when(both, 1))
    ok = (n >= least) & (F.max(a) > F.min(a)) & (F.max(b) > F.min(b))
    return F.when(ok, F.covar_samp(a, b) / F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0)))


def zscore(x: Column, w: WindowSpec) -> Column:
    """Population z-score; a degenerate group is 0 for non-null values."""
    sd = F.stddev_pop(x).over(w)
    return F.when(x.isNull(), None).when(F.coalesce(sd, F.lit(0.0)) > 0, (x - F.avg(x).over(w)) / F.nullif(sd, F.lit(0.0))).otherwise(F.lit(0.0))


def quantile(x: Column, q: float) -> Column:
    """Exact, linear between ranks."""
    return F.percentile(x, F.lit(q))


def quantiles(df: DataFrame, columns: dict[str, Column], at: list[float], keys: list[str] | None = None, margin: float = 3e-4) -> dict[tuple, dict[str, list[float | None]]]:
    """By values of ``keys`` (a few) and name: the numbers that :func:`quantile` gives for each of ``at``, for groups of any size; ``df`` is read three times.

    Sketches (``percentile_approx``) give a range around each quantile; what is below it is counted, and only the values within are put in order, a few of ten thousand.
    A range that misses its quantile is widened, up to all values.
    """
    keys, names = keys or [], list(columns)
    x = df.select(*keys, *[c.cast("double").alias(f"__x{i}") for i, c in enumerate(columns.values())])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], F.lit(True))
    named = lambda g: tuple(g[k] for k in keys)
    each = [(i, q) for i in range(len(names)) for q in range(len(at))]
    sizes: dict[tuple, list[int]] = {}
    found: dict[tuple, dict[str, list[float | None]]] = {}
    left: set[tuple] = set()
    while left or not sizes:
        wide = margin >= 1
        ends = [(max(0.0, p - margin), min(1.0, p + margin)) for p in at]
        asked = F.array(*[F.lit(v) for e in ends for v in e])
        open_ = F.array(*[F.lit(v) for _ in at for v in (float("-inf"), float("nan"))])
        sketch = x.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(*[f for i in range(len(names)) for f in (F.count(f"__x{i}").alias(f"n{i}"), (F.max(open_) if wide else F.percentile_approx(f"__x{i}", asked, 10000)).alias(f"e{i}"))])
        held = sketch.collect()  # a row a group
        if not held:
            break
        if not sizes:
            sizes = {tuple(g[f"__k_{k}"] for k in keys): [g[f"n{i}"] for i in range(len(names))] for g in held}
            found = {g: {c: [None] * len(at) for c in names} for g in sizes}
            left = {(g, i, q) for g, n in sizes.items() for i, q in each if n[i]}
        if not left:
            break
        ranges = df.sparkSession.createDataFrame(held, sketch.schema)
        lo, hi = lambda i, q: F.col(f"e{i}")[2 * q], lambda i, q: F.col(f"e{i}")[2 * q + 1]
        both = x.join(F.broadcast(ranges), same)
        below = {named(g): g for g in both.groupBy(*keys).agg(*[F.count_if(F.col(f"__x{i}") < lo(i, q)).alias(f"b{i}_{q}") for i, q in each]).collect()}
        inside = F.array(*[F.when((F.col(f"__x{i}") >= lo(i, q)) & (F.col(f"__x{i}") <= hi(i, q)), F.struct(F.lit(i).alias("i"), F.lit(q).alias("q"), F.col(f"__x{i}").alias("v"))) for i, q in each])
        values = both.select(*keys, F.explode(F.array_compact(inside)).alias("__m")).groupBy(*keys, "__m").agg(F.count("*").alias("__many")).select(*keys, "__m.*", "__many")
        ranks = [(g, i, q, r) for g, i, q in left for r in {math.floor(at[q] * (sizes[g][i] - 1)), math.ceil(at[q] * (sizes[g][i] - 1))}]
        wanted = df.sparkSession.createDataFrame([(*g, i, q, r - below[g][f"b{i}_{q}"]) for g, i, q, r in ranks], StructType([*[StructField(f"__k_{k}", df.schema[k].dataType) for k in keys], StructField("wi", IntegerType()), StructField("wq", IntegerType()), StructField("rank", LongType())]))
        run = F.sum("__many").over(Window.partitionBy(*keys, "i", "q").orderBy("v"))
        hit = same & (F.col("i") == F.col("wi")) & (F.col("q") == F.col("wq")) & (F.col("rank") < F.col("__run")) & (F.col("rank") >= F.col("__run") - F.col("__many"))
        got = {(named(g), g["i"], g["q"], g["rank"] + below[named(g)][f"b{g['i']}_{g['q']}"]): g["v"] for g in values.withColumn("__run", run).join(F.broadcast(wanted), hit).collect()}
        for g, i, q in sorted(left, key=str):
            place = at[q] * (sizes[g][i] - 1)
            low, high = got.get((g, i, q, math.floor(place))), got.get((g, i, q, math.ceil(place)))
            if low is not None and high is not None:
                # As Spark's percentile rounds it.
                found[g][names[i]][q] = low if low == high or math.floor(place) == math.ceil(place) else (math.ceil(place) - place) * low + (place - math.floor(place)) * high
                left.discard((g, i, q))
        margin *= 30
    return found


def interpolated(df: DataFrame, keys: list[str], x: Column, q: float, name: str) -> DataFrame:
    """``df`` with ``name``, the exact quantile of ``x`` over its keys, linear between ranks and rounded once (a fused product and sum): the number that DuckDB's quantile_cont gives, to the last bit.

    :func:`quantile` rounds both products, so that what is on the edge of a bin made from it may fall to the other side.
    """
    w = Window.partitionBy(*keys)
    at = F.lit(q) * (F.count("__x").over(w) - 1)
    rows = df.withColumn("__x", x.cast("double")).withColumns({"__at": at, "__rank": F.row_number().over(w.orderBy(F.asc_nulls_last("__x"))) - 1})
    value = lambda rank: F.max(F.when(F.col("__rank") == rank, F.col("__x"))).over(w)
    rows = rows.withColumns({"__lo": value(F.floor("__at")), "__hi": value(F.ceil("__at")), "__part": F.col("__at") - F.floor("__at")})
    fused = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), F.coalesce("__lo", F.lit(0.0)), 1 - F.col("__part"), F.coalesce(F.col("__hi") * F.col("__part"), F.lit(0.0))).cast("double")
    return rows.withColumn(name, F.when(F.col("__part") > 0, F.when(F.col("__lo").isNotNull(), fused)).otherwise(F.col("__lo"))).drop("__x", "__at", "__rank", "__lo", "__hi", "__part")


def robust_z(x: Column, w: WindowSpec, fallback: Column | None = None, otherwise: float | None = None) -> Column:
    """(x - median) / IQR, with another scale where the IQR isn't positive."""
    iqr = quantile(x, 0.75).over(w) - quantile(x, 0.25).over(w)
    scale = F.when(iqr > 0, iqr)
    if fallback is not None:
        scale = F.coalesce(scale, F.when(fallback > 0, fallback))
    z = (x - F.median(x).over(w)) / scale
    return z if otherwise is None else F.when(x.isNotNull(), F.coalesce(z, F.lit(otherwise)))


def with_spreads(df: DataFrame, keys: list[str], columns: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with ``__q_<c>`` (quartiles), ``__sd_<c>`` of each column over its keys, and ``extra`` aggregates: summed up and joined back, so a large group isn't gathered."""
    aggs = [F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"__q_{c}") for c in columns]
    aggs += [F.stddev_samp(c).alias(f"__sd_{c}") for c in columns] + [x.alias(n) for n, x in (extra or {}).items()]
    found = df.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(*aggs)
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return df.join(found, on, "left").drop(*[f"__k_{k}" for k in keys])


def spread_z(c: str, otherwise: float | None = None) -> Column:
    """(x - median) / IQR after :func:`with_spreads`; the standard deviation is the scale where the IQR isn't positive."""
    x, q, sd = F.col(c), F.col(f"__q_{c}"), F.col(f"__sd_{c}")
    z = (x - q[1]) / F.coalesce(F.when(q[2] - q[0] > 0, q[2] - q[0]), F.when(sd > 0, sd))
    return z if otherwise is None else F.when(x.isNotNull(), F.coalesce(z, F.lit(otherwise)))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
