"""Bootstraps of whole participants and permutations of labels, as sums that Spark adds up.

A bootstrap gives every participant a Poisson(1) count in every replicate, from a seed of its name and the bootstrap's, so replicates are sums over
participants: a task multiplies its participants' sums by their counts and hands on one row a replicate.  Nothing but replicates is collected, and a lost task
repeats the same counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.plans.staging import staged

#: Counts that a task holds at once: a batch's participants are taken in pieces, however many replicates there are.
HELD = 1 << 20


def counts_of(people: list, repetitions: int, seed: int) -> np.ndarray:
    """Poisson(1) counts, a row a participant and a column a replicate."""
    out = np.empty((len(people), repetitions))
    for i, p in enumerate(people):
        out[i] = np.random.default_rng([seed, zlib.crc32(str(p).encode())]).poisson(1.0, repetitions)
    return out


def replicate_sums(sums: DataFrame, person: str, *, keys: list[str] | None = None, repetitions: int = 500, seed: int = 42) -> DataFrame:
    """keys, replicate and ``v``: the other columns of ``sums`` (a row a participant and key), summed over the participants of each replicate."""
    keys = keys or []
    names = [c for c in sums.columns if c not in (person, *keys)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in b.columns[1 + len(keys) :]])
            people, step = b.column(0).to_pylist(), max(1, HELD // repetitions)
            group: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(*(c.to_pylist() for c in b.columns[1 : 1 + len(keys)]), strict=True) if keys else [()] * b.num_rows):
                group.setdefault(k, []).append(i)
            for k, at in group.items():
                for lo in range(0, len(at), step):
                    some = at[lo : lo + step]
                    v = counts_of([people[i] for i in some], repetitions, seed).T @ x[some]
                    held[k] = held[k] + v if k in held else v
        for k, v in held.items():
            columns = [pa.array([k[j]] * repetitions, kinds[j]) for j in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(range(repetitions), pa.int64()), pa.array(v.tolist(), pa.list_(pa.float64()))], names=[*keys, "replicate", "v"])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(sums.schema[k].dataType) for k in keys]
    fields = "".join(f"{k} {sums.schema[k].dataType.simpleString()}, " for k in keys)
    parts = sums.select(person, *keys, *names).mapInArrow(run, fields + "replicate long, v array<double>")
    return parts.groupBy(*keys, "replicate").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(len(names))]).alias("v"))


def bootstrap(sums: DataFrame, person: str, statistic: Callable[[np.ndarray], float], *, repetitions: int = 500, seed: int = 42) -> DataFrame:
    """(replicate, value): ``statistic`` of the summed columns of participants drawn with replacement."""

    @F.pandas_udf("double")
    def value(v: pd.Series) -> pd.Series:
        return v.map(lambda x: float(statistic(np.asarray(x, dtype=float)))).astype(float)

    out = replicate_sums(sums, person, repetitions=repetitions, seed=seed).select("replicate", value("v").alias("value"))
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def interval(replicates: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    return replicates.agg(F.count("value").alias("replicates"), F.percentile("value", F.lit(low)).alias("lower"), F.percentile("value", F.lit(high)).alias("upper"))


def effect_sums(df: DataFrame, participant: str, group: str, outcome: str) -> DataFrame:
    """Counts and sums of an outcome in groups 1 and 0, a row a participant."""
    hit = lambda g: (F.col(group) == g) & F.col(outcome).isNotNull()
    return df.groupBy(participant).agg(*[f.alias(n) for g in (1, 0) for n, f in ((f"n{g}", F.count(F.when(hit(g), 1))), (f"s{g}", F.sum(F.when(hit(g), F.col(outcome)).otherwise(0.0))))])


def difference(v: np.ndarray) -> float:
    return v[1] / v[0] - v[3] / v[2] if v[0] and v[2] else np.nan


def odds_ratio(v: np.ndarray) -> float:
    """Of counts a, b, c, d with half a case added to each."""
    a, b, c, d = v + 0.5
    return float(a * d / (b * c))


def permutation_p(observed: float, null: np.ndarray) -> float:
    return (1 + int((null >= observed).sum())) / (len(null) + 1)


def permuted_agreement(df: DataFrame, stratum: str, person: str, label: str, repetitions: int = 200, seed: int = 42, fan: int = 64) -> DataFrame:
    """Share of equal pairs of labels within persons, its mean and p-value under permutation of the labels within a stratum.

    Permuting the labels of a stratum deals its label counts to its persons without replacement, so only counts are needed.  They are dealt down a tree: a stratum's counts to up to
    ``fan`` blocks of persons by hypergeometric draws, each block's to its blocks, and at the leaves to persons.  Every node draws from a seed of its own name, so blocks are tasks of their own, whatever the
    size of a stratum, and a repeated task draws the same.
    """
    rows = df.filter(F.col(label).isNotNull())
    cells = rows.groupBy(stratum, person, label).agg(F.count("*").alias("k"))
    sizes = staged(cells.groupBy(stratum, person).agg(F.sum("k").alias("n"), F.sum(F.col("k") * (F.col("k") - 1)).alias("same")), "persons")
    most = sizes.groupBy(stratum).count().agg(F.max("count")).first()[0] or 0
    depth = 0
    while fan ** (depth + 1) < most:
        depth += 1
    # A person's block at level d is the first digits of its hash, in base ``fan``.
    digits = F.pmod(F.xxhash64(F.lit(seed), F.col(person)), F.lit(fan**depth))
    placed = sizes.withColumn("leaf", digits)
    labels = cells.groupBy(stratum, label).agg(F.sum("k").alias("k")).groupBy(stratum).agg(F.sort_array(F.collect_list("k")).alias("labels"))
    kind = sizes.schema[stratum].dataType.simpleString()

    def drawn(left: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
        """n of the labels that are left, in each repetition."""
        rest, out = np.full(len(left), n), np.zeros_like(left)
        for j in range(left.shape[1]):
            others = left[:, j + 1 :].sum(axis=1)
            out[:, j] = rng.hypergeometric(left[:, j], others, rest) if others.any() else rest
            rest = rest - out[:, j]
        return out

    def generator(key, level: int, node: int) -> np.random.Generator:
        return np.random.default_rng([seed, zlib.crc32(str(key).encode()), level, node])

    def split(level: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            first = pdf.iloc[0]
            left = np.frombuffer(first["dealt"], np.int64).reshape(repetitions, -1).copy()
            rng, out = generator(first[stratum], level, int(first["node"])), []
            for node, n in sorted(zip(pdf["child"], pdf["n"], strict=True)):
                part = drawn(left, int(n), rng)
                left -= part
                out.append((first[stratum], node, part.tobytes()))
            return pd.DataFrame(out, columns=[stratum, "node", "dealt"])

        return run

    def persons(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        left = np.frombuffer(first["dealt"], np.int64).reshape(repetitions, -1).copy()
        rng, same = generator(first[stratum], depth, int(first["node"])), np.zeros(repetitions)
        for n in pdf.sort_values(person)["n"]:
            part = drawn(left, int(n), rng)
            left -= part
            same += (part * (part - 1)).sum(axis=1)
        return pd.DataFrame({"same": [same.tolist()]})

    def repeated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({stratum: pdf[stratum], "node": 0, "dealt": [np.tile(np.asarray(v, np.int64), (repetitions, 1)).tobytes() for v in pdf["labels"]]})

    nodes = labels.mapInPandas(repeated, f"{stratum} {kind}, node long, dealt binary")
    for level in range(depth):
        up, down = fan ** (depth - level), fan ** (depth - level - 1)
        children = placed.groupBy(stratum, F.floor(F.col("leaf") / up).alias("node"), F.floor(F.col("leaf") / down).alias("child")).agg(F.sum("n").alias("n"))
        nodes = staged(children.join(nodes, [stratum, "node"]).groupBy(stratum, "node").applyInPandas(split(level), f"{stratum} {kind}, node long, dealt binary"), "dealt")
    leaves = placed.withColumnRenamed("leaf", "node").join(nodes, [stratum, "node"]).groupBy(stratum, "node").applyInPandas(persons, "same array<double>")
    null = leaves.select(F.posexplode("same").alias("replicate", "same")).groupBy("replicate").agg(F.sum("same").alias("same"))
    seen = sizes.agg(F.sum("same").cast("double").alias("observed"), F.sum(F.col("n") * (F.col("n") - 1)).cast("double").alias("pairs"))
    both = null.join(seen, F.lit(True))
    out = both.agg(F.first("observed").alias("o"), F.first("pairs").alias("p"), F.avg("same").alias("m"), F.count(F.when(F.col("same") >= F.col("observed"), 1)).alias("above"), F.count("*").alias("r"))
    share = lambda c: F.col(c) / F.nullif("p", F.lit(0.0))
    return out.select(share("o").alias("pair_agreement"), share("m").alias("permuted_agreement"), ((1 + F.col("above")) / (1 + F.col("r"))).alias("p_value"))


def profile_odds(v: np.ndarray, profiles: int) -> list[tuple[float, float]]:
    """(rate, one-vs-rest odds ratio) of each profile, from counts without the event of all profiles and then with it."""
    kept, low = v[:profiles], v[profiles:]
    total, events = kept + low, low.sum()
    return [
        (low[i] / total[i] if total[i] else np.nan, (low[i] + 0.5) * (kept.sum() - kept[i] + 0.5) / ((kept[i] + 0.5) * (events - low[i] + 0.5)))
        for i in range(profiles)
    ]


def profile_association(df: DataFrame, person: str, profile: str, event: str, *, repetitions: int = 500, seed: int = 42) -> DataFrame:
    """profile, n, rate of ``event`` (a boolean), one-vs-rest odds ratio (half a case added to each count), and intervals by bootstrap of whole participants."""
    rows = df.filter(F.col(profile).isNotNull() & F.col(event).isNotNull())
    names = sorted(r[0] for r in rows.select(profile).distinct().collect())
    hit = lambda p, e: F.count(F.when((F.col(profile) == p) & (F.col(event) == F.lit(e)), 1))
    counts = [hit(p, e).alias(f"{'x' if e else 'y'}{i}") for e in (False, True) for i, p in enumerate(names)]
    found = rows.agg(*counts).select(F.lit(-1).cast("long").alias("replicate"), F.array(*[F.expr(f"cast({'x' if e else 'y'}{i} as double)") for e in (False, True) for i in range(len(names))]).alias("v"))
    drawn = replicate_sums(rows.groupBy(person).agg(*counts), person, repetitions=repetitions, seed=seed)

    def rates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(int(r), names[i], float(sum(v[i :: len(names)])), *x) for r, v in zip(pdf["replicate"], pdf["v"], strict=True) for i, x in enumerate(profile_odds(np.asarray(v, float), len(names)))]
            yield pd.DataFrame(out, columns=["replicate", "profile", "n", "rate", "odds"])

    each = found.unionByName(drawn).mapInPandas(rates, "replicate long, profile string, n double, rate double, odds double")
    own, boot = F.col("replicate") < 0, F.col("replicate") >= 0
    at = lambda c, q: F.percentile(F.when(boot & ~F.isnan(c), F.col(c)), F.lit(q))
    return each.groupBy("profile").agg(
        F.max(F.when(own, F.col("n"))).cast("long").alias("n"), F.max(F.when(own, F.col("rate"))).alias("rate"), at("rate", 0.025).alias("rate_lower"), at("rate", 0.975).alias("rate_upper"),
        F.max(F.when(own, F.col("odds"))).alias("odds_ratio"), at("odds", 0.5).alias("odds_ratio_median"), at("odds", 0.025).alias("odds_ratio_lower"), at("odds", 0.975).alias("odds_ratio_upper"),
    )
