"""Stability of density clusters: bootstraps of whole participants, fitted together, and the overlap of their clusters with those of all rows.

A replicate draws each participant a Poisson number of times, so its rows are the given ones with a count.  All replicates share the passes over pairs of rows: a strip or a tile takes its distances once, and every
replicate reads its core distances, the edges of its spanning tree and the nearest sampled rows from them.  A strip of rows passes over all others, which its task is sent as a whole; a tile has two blocks.  No row reaches
the driver; the edges of a replicate's tree, one a row, are condensed in order by one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.operators.density import TINY, condensed, density_clusters
from trialweave.operators.models import dense_places
from trialweave.operators.pairs import blocks, distances, squares, strips, tiles
from trialweave.operators.resampling import counts_of
from trialweave.plans.staging import staged

#: Rows that say where a row's core distance is, about.
SAMPLE = 1 << 14
#: Numbers that a strip of rows may hold, and distances that are taken at once.
HELD, TILE = 1 << 24, 1 << 16
#: Rows that a strip meets at a time.
CHUNK = 1 << 13
#: Rows of a block: a row carries some numbers of each replicate.
BLOCK = 256


def weighted_cores(rows: DataFrame, features: list[str], counts: list[str], least: int, size: int = BLOCK) -> DataFrame:
    """``rows`` (r, features, counts by replicate) with ``core0``, ``core1``, ...: the distance within which more than ``least`` rows of the replicate are, a row's own copies included; infinite where it has none.

    The total of each replicate's counts has to be over ``least``.  A strip of rows makes one pass over all rows for all replicates: the first :data:`SAMPLE` of them (any, as ``r`` has nothing to do with the features)
    say between which two distances those that are looked for must be, the weight below that range is added up and only what is within it is held and sorted.  Rows whose range misses get another pass, which holds all distances.
    """
    d, k = len(features), len(counts)
    columns = [*features, "r", *counts]
    width = d + 1 + k
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"t{j}") for j, c in enumerate(counts)]).first()
    n, share = sums["n"], [least / sums[f"t{j}"] for j in range(k)]
    low, high = min(share), max(share)
    names = ["r", *features, *counts, *[f"core{j}" for j in range(k)]]
    kinds = ", ".join(f"{c} {'long' if c in ('r', 'missed') else 'double'}" for c in [*names, "missed"])

    def within(x: np.ndarray, squared: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squares between which those of the rows' distances are, by all that the sample says."""
        total = weight.sum()
        error = 5 * np.sqrt(high * (weight**2).sum()) / total if total else 1.0
        if k > 1:
            error += 8 * np.sqrt(high / n)
        lo, hi = np.full(len(x), -np.inf), np.full(len(x), np.inf)
        for i, q in enumerate(squared):
            order = q.argsort()
            run = weight[order].cumsum() / total
            if low - error > 0:
                lo[i] = q[order[min(run.searchsorted(low - error), len(q) - 1)]]
            if high + error < 1:
                hi[i] = q[order[min(run.searchsorted(high + error), len(q) - 1)]]
        return lo, hi

    def cores(every: bool):
        def of(x: np.ndarray, chunks: Iterator[np.ndarray]) -> list[np.ndarray]:
            below, lo, hi = np.zeros((len(x), k)), np.full(len(x), -np.inf), np.full(len(x), np.inf)
            held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in x]
            first: list[np.ndarray] = []

            def add(y: np.ndarray) -> None:
                w, step = np.ascontiguousarray(y[:, d + 1 :], np.float32), max(1, TILE // len(y))
                about = np.concatenate([-2 * y[:, :d], np.ones((len(y), 1)), (y[:, :d] ** 2).sum(axis=1)[:, None]], axis=1).T.astype(np.float32)
                for at in range(0, len(x), step):
                    s = slice(at, at + step)
                    q = squares(x[s, :d], y[:, :d]) if every else left[s] @ about
                    if every:
                        inside = np.ones(q.shape, bool)
                    else:
                        under = q < low32[s, None]
                        below[s] += under.astype(np.float32) @ w
                        inside = (q <= high32[s, None]) ^ under
                    i, c = np.divmod(np.flatnonzero(inside), len(y))
                    exact = np.zeros(len(i))
                    for j in range(d):
                        exact += (x[at + i, j] - y[c, j]) ** 2
                    cuts = np.searchsorted(i, np.arange(1, len(q)))
                    for row, one, there in zip(held[s], np.split(exact, cuts), np.split(c, cuts), strict=True):
                        row.append((one, w[there]))

            if not every and n > SAMPLE:
                size = 0
                while size < SAMPLE and (y := next(chunks, None)) is not None:
                    first.append(y)
                    size += len(y)
                near = np.concatenate(first)
                weight = near[:, d + 1 :].sum(axis=1)
                step = max(1, (1 << 20) // len(near))
                for at in range(0, len(x), step):
                    lo[at : at + step], hi[at : at + step] = within(x[at : at + step], squares(x[at : at + step, :d], near[:, :d]), weight)
            norm = (x[:, :d] ** 2).sum(axis=1)
            left = np.concatenate([x[:, :d], norm[:, None], np.ones((len(x), 1))], axis=1).astype(np.float32)
            low32, high32 = lo.astype(np.float32), hi.astype(np.float32)
            doubt = 1e-5 * (norm + np.where(np.isfinite(hi), hi, 0))  # what the products may be off by
            for y in chain(first, chunks):
                add(y)
            core, missed = np.full((len(x), k), np.inf), np.zeros(len(x), np.int64)
            for i, parts in enumerate(held):
                q, w = (np.concatenate(p) for p in zip(*parts, strict=True))
                order = q.argsort()
                enough = below[i] + w[order].cumsum(axis=0) > least
                missed[i] = (below[i] > least).any() or not enough[-1:].all() or not len(q)
                if not missed[i]:
                    found = q[order][enough.argmax(axis=0)]
                    missed[i] = not every and bool(((found <= lo[i] + doubt[i]) | (found >= hi[i] - doubt[i])).any())
                    core[i] = np.where(x[i, d + 1 :] > 0, np.sqrt(found), np.inf)
            return [x[:, d].astype(np.int64), *x[:, :d].T, *x[:, d + 1 :].T, *core.T, missed]

        return of

    chunks = blocks(rows.select(*columns), columns, max(size, CHUNK), "r")
    # A row holds what is within its range, some hundredths of all rows.
    packed = blocks(rows.select(*columns), columns, max(8, min(512, HELD // max(1, min(n, n // 24 + SAMPLE) * (1 + k)))), "r")
    found = staged(strips(packed, chunks, cores(False), width, kinds), "cores")
    again = found.filter("missed > 0")
    if not again.isEmpty():
        packed = blocks(again.select(*columns), columns, max(1, min(512, HELD // (n * (1 + k)))), "r")
        found = found.filter("missed = 0").unionAll(staged(strips(packed, chunks, cores(True), width, kinds), "cores"))
    return found.select(*names)


def _by_tile(packed: DataFrame, width: int, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], d: int, kinds: str) -> DataFrame:
    """Rows of ``of(rows, others, distances)``, for every block against every block."""
    fields = [f.split() for f in kinds.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py()).reshape(-1, width) for v in (a, b))
                dist = distances(x[:, :d], y[:, :d])
                out = of(x, y, dist) if i == j else np.concatenate([of(x, y, dist), of(y, x, dist.T)])
                yield pa.RecordBatch.from_arrays([pa.array(out[:, c].astype(np.int64) if kind == "long" else out[:, c].copy()) for c, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])

    return tiles(packed).mapInArrow(work, kinds)


def weighted_trees(rows: DataFrame, features: list[str], k: int, size: int = BLOCK) -> DataFrame:
    """replicate, w, a, b: the edges of each replicate's spanning tree of rows (r, features, core0, ...; infinite: not in it), by Boruvka's rounds over shared tiles."""
    d = len(features)
    cores = [f"core{j}" for j in range(k)]
    width = d + 1 + 2 * k
    member = F.explode(F.array(*[F.struct(F.lit(j).cast("long").alias("replicate"), F.col(c).alias("core")) for j, c in enumerate(cores)]))
    members = staged(rows.select("r", member.alias("m")).select("r", "m.*").filter("core < double('inf')").select("replicate", "r", F.col("r").alias("comp")), "members")
    edges: list[DataFrame] = []

    def nearest(x: np.ndarray, y: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """(replicate, component, w, a, b, other component): the least (w, a, b) of each component of x to another one; rows are in order of their numbers."""
        found = [np.zeros((0, 6))]
        for j in range(k):
            mine, theirs = np.flatnonzero(np.isfinite(x[:, d + 1 + j])), np.flatnonzero(np.isfinite(y[:, d + 1 + j]))
            if not len(mine) or not len(theirs):
                continue
            a, b = x[mine], y[theirs]
            mutual = np.maximum(np.maximum(dist[np.ix_(mine, theirs)], a[:, d + 1 + j, None]), b[None, :, d + 1 + j])
            mutual[a[:, d + 1 + k + j, None] == b[None, :, d + 1 + k + j]] = np.inf
            at = mutual.argmin(axis=1)
            w = mutual[np.arange(len(a)), at]
            out = np.column_stack([np.full(len(a), j), a[:, d + 1 + k + j], w, np.minimum(a[:, d], b[at, d]), np.maximum(a[:, d], b[at, d]), b[at, d + 1 + k + j]])[np.isfinite(w)]
            out = out[np.lexsort((out[:, 4], out[:, 3], out[:, 2], out[:, 1]))]
            new = np.ones(len(out), bool)
            new[1:] = out[1:, 1] != out[:-1, 1]
            found.append(out[new])
        return np.concatenate(found)

    while True:
        comps = members.groupBy("r").agg(*[F.max(F.when(F.col("replicate") == j, F.col("comp"))).alias(f"comp{j}") for j in range(k)])
        held = rows.select("r", *features, *cores).join(comps, "r").fillna(-1, [f"comp{j}" for j in range(k)])
        packed = blocks(held, [*features, "r", *cores, *[f"comp{j}" for j in range(k)]], size, "r")
        found = _by_tile(packed, width, nearest, d, "replicate long, comp long, w double, a long, b long, other long")
        best = staged(found.groupBy("replicate", "comp").agg(F.min(F.struct("w", "a", "b", "other")).alias("e")).select("replicate", "comp", "e.*"), "shortest")
        if best.isEmpty():
            break
        edges.append(staged(best.select("replicate", "w", "a", "b").distinct(), "edges"))
        back = best.select("replicate", F.col("comp").alias("other"), F.col("other").alias("back"))
        root = (F.col("back") == F.col("comp")) & (F.col("comp") < F.col("other"))
        up = staged(best.join(back, ["replicate", "other"]).select("replicate", "comp", F.when(root, F.col("comp")).otherwise(F.col("other")).alias("up")), "up")
        while True:  # every component's root, in doubled steps
            above = up.select("replicate", F.col("comp").alias("up"), F.col("up").alias("next"))
            stepped = staged(up.join(above, ["replicate", "up"]).select("replicate", "comp", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "up")
            up = stepped.select("replicate", "comp", "up")
            if stepped.filter("moved").isEmpty():
                break
        joined = members.join(up, ["replicate", "comp"], "left")
        members = staged(joined.select("replicate", "r", F.coalesce("up", "comp").alias("comp")), "members")
    out = rows.sparkSession.createDataFrame([], "replicate long, w double, a long, b long")
    for e in edges:
        out = out.unionAll(e)
    return out


def _replicate_labels(least: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def label(key: tuple, tree: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("r")
        r = nodes["r"].to_numpy()
        begin = np.zeros(len(r))
        if len(tree):
            tree = tree.sort_values(["w", "a", "b"])
            ends = (np.searchsorted(r, tree[c].to_numpy()).tolist() for c in ("a", "b"))
            found, begins = condensed(len(r), list(zip(tree["w"].tolist(), *ends, strict=True)), least, nodes["copies"].to_numpy(np.int64), nodes["core"].to_numpy())
            if len(begins):
                begin = np.where(found >= 0, begins[found], 0.0)
        else:
            found = np.full(len(r), -1)
        return pd.DataFrame({"replicate": key[0], "r": r, "label": found, "begins": begin})

    return label


def predicted(rows: DataFrame, features: list[str], counts: list[str], least: int, size: int = BLOCK) -> DataFrame:
    """replicate, r, label: the cluster of every row in each replicate.  A row that is in it keeps its own; another one takes that of an equal row, else of the nearest by mutual reachability, if that is dense enough for the cluster, else -1."""
    d, k = len(features), len(counts)
    rows = weighted_cores(rows, features, counts, least, size)
    tree = weighted_trees(rows, features, k, size)
    node = F.explode(F.array(*[F.struct(F.lit(j).cast("long").alias("replicate"), F.col(c).alias("copies"), F.col(f"core{j}").alias("core")) for j, c in enumerate(counts)]))
    nodes = rows.select("r", node.alias("m")).select("r", "m.*").filter("copies > 0")
    cogrouped = tree.groupBy("replicate").cogroup(nodes.groupBy("replicate"))
    own = staged(cogrouped.applyInPandas(_replicate_labels(least), "replicate long, r long, label long, begins double"), "labels")
    wide = own.groupBy("r").agg(*[F.max(F.when(F.col("replicate") == j, F.col(c))).alias(f"{c}{j}") for c in ("label", "begins") for j in range(k)])
    held = rows.select("r", *features, *[f"core{j}" for j in range(k)]).join(wide, "r", "left").fillna(-1, [f"label{j}" for j in range(k)]).fillna(0.0, [f"begins{j}" for j in range(k)])
    columns = [*features, "r", *[f"{c}{j}" for c in ("core", "label", "begins") for j in range(k)]]

    def nearest(x: np.ndarray, y: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """(replicate, r, other than equal, reach, its row, label, begins) of rows that aren't in the replicate."""
        found = [np.zeros((0, 7))]
        for j in range(k):
            mine, theirs = np.flatnonzero(~np.isfinite(x[:, d + 1 + j])), np.flatnonzero(np.isfinite(y[:, d + 1 + j]))
            if not len(mine) or not len(theirs):
                continue
            near, i = dist[np.ix_(mine, theirs)], np.arange(len(mine))
            reach = np.maximum(near, y[None, theirs, d + 1 + j])
            least_d, at = near.argmin(axis=1), reach.argmin(axis=1)
            equal = near[i, least_d] == 0
            to = np.where(equal, least_d, at)
            b = y[theirs[to]]
            found.append(np.column_stack([np.full(len(mine), j), x[mine, d], ~equal, np.where(equal, 0.0, reach[i, to]), b[:, d], b[:, d + 1 + k + j], b[:, d + 1 + 2 * k + j]]))
        return np.concatenate(found)

    packed = blocks(held, columns, size, "r")
    near = _by_tile(packed, len(columns), nearest, d, "replicate long, r long, apart long, reach double, s long, label long, begins double")
    best = near.groupBy("replicate", "r").agg(F.min(F.struct("apart", "reach", "s", "label", "begins")).alias("e")).select("replicate", "r", "e.*")
    dense = (F.col("apart") == 0) | (1 / F.greatest("reach", F.lit(TINY)) >= F.col("begins"))
    return own.select("replicate", "r", "label").unionAll(best.select("replicate", "r", F.when(dense, F.col("label")).otherwise(F.lit(-1)).alias("label")))


def overlaps(labels: DataFrame, by: str, reference: str, candidate: str, copies: str | None = None) -> DataFrame:
    """``by``, clusters, jaccard: the mean over the clusters of ``reference`` of the best overlap (intersection over union) with one of ``candidate``; -1 is noise, a group without clusters of both has no row.

    ``copies``: a column that says how many rows a row stands for.
    """
    c = labels.groupBy(by, F.col(reference).alias("a"), F.col(candidate).alias("b")).agg(F.sum(copies).alias("k") if copies else F.count("*").alias("k"))
    left = c.filter("a >= 0").groupBy(by, "a").agg(F.sum("k").alias("n"))
    right = c.filter("b >= 0").groupBy(by, "b").agg(F.sum("k").alias("m"))
    best = c.filter("a >= 0 and b >= 0").join(right, [by, "b"]).join(left, [by, "a"]).groupBy(by, "a").agg(F.max(F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).alias("j"))
    mean = left.join(best, [by, "a"], "left").groupBy(by).agg(F.avg(F.coalesce("j", F.lit(0.0))).alias("jaccard"))
    return right.groupBy(by).agg(F.count("*").alias("clusters")).join(mean, by).select(by, "clusters", "jaccard")


def density_stability(df: DataFrame, features: list[str], key: str, person: str, *, repetitions: int = 50, least: int = 20, share: float = 0.05, seed: int = 42, size: int = BLOCK) -> DataFrame:
    """replicate, clusters, jaccard: the overlap of the density clusters of all rows with those that bootstraps of participants give to all rows.

    Rows that miss a feature are left out, a row without a participant is in no replicate.  A replicate of too few rows or without clusters has no row, as all have where the rows have no cluster.
    """
    k = len(features)

    @F.pandas_udf("array<double>")
    def drawn(people: pd.Series) -> pd.Series:
        return pd.Series([c if p is not None else c * 0 for p, c in zip(people, counts_of(people.tolist(), repetitions, seed).astype(float), strict=True)])

    clean = [(F.col(c).cast("double") + 0.0).alias(f"f{j}") for j, c in enumerate(features)]
    named = df.select(F.col(key).alias("k"), F.col(person).cast("string").alias("p"), *clean).dropna(subset=[f"f{j}" for j in range(k)]).filter(" and ".join(f"not isnan(f{j})" for j in range(k)))
    columns = [f"f{j}" for j in range(k)]
    found = density_clusters(named, columns, "k", least=least, share=share).withColumn("w", drawn("p"))
    # Equal rows have one cluster in all rows and in each replicate: they are one row, which is drawn as often as all of them.
    same = found.groupBy(*columns, "cluster").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.xxhash64("k").alias("h"), "k", "p")).alias("first"), F.array(*[F.sum(F.col("w")[j]) for j in range(repetitions)]).alias("w"))
    rows = staged(dense_places(same.select(*columns, "cluster", "copies", "w", "first.*"), ["h", "k", "p"], "r"), "drawn")
    n = rows.agg(F.sum("copies")).first()[0] or 0
    smallest = max(least, int(np.ceil(share * n)))
    totals = rows.agg(*[F.sum(F.col("w")[j]).alias(f"t{j}") for j in range(repetitions)]).first()
    usable = [j for j in range(repetitions) if (totals[f"t{j}"] or 0) > smallest]
    if not usable or rows.filter("cluster >= 0").isEmpty():
        return df.sparkSession.createDataFrame([], "replicate int, clusters long, jaccard double")
    counts = [f"w{j}" for j in range(len(usable))]
    got = predicted(rows.select("r", *columns, *[F.col("w")[j].alias(c) for c, j in zip(counts, usable, strict=True)]), columns, counts, smallest, size)
    both = got.join(rows.select("r", "copies", F.col("cluster").alias("base")), "r")
    number = F.array(*[F.lit(j) for j in usable])[F.col("replicate").cast("int")]
    return overlaps(both, "replicate", "base", "label", "copies").select(number.alias("replicate"), "clusters", "jaccard")
