"""Density clustering with noise: a hierarchy of mutual reachability, condensed, with the clusters of most excess mass.

The hierarchy is of all rows.  Its core distances take the square of the rows, in strips that pass over all others (a task is sent the numbers of all rows), its spanning tree (Boruvka's rounds) that of those near the
borders of components, in tiles of two blocks.  No row reaches the driver.  The edges of the tree, three numbers a row, are condensed in order by one task, which needs some numbers a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.operators.models import dense_places
from trialweave.operators.pairs import BLOCK, blocks, distances, strips, tile_sums, tiles
from trialweave.plans.staging import staged

TINY = 1e-12
#: Parts of the range that holds a row's core distance, in a pass.
BINS = 512


@dataclass
class Hierarchy:
    """Sampled rows with their core distances and labels (-1: noise), and the density at which each cluster begins."""

    points: np.ndarray
    core: np.ndarray
    labels: np.ndarray
    begins: np.ndarray

    def label(self, x: np.ndarray) -> np.ndarray:
        """The cluster of the nearest row by mutual reachability, if that is dense enough for it; a sampled row keeps its own."""
        out = np.full(len(x), -1)
        if not len(self.points):
            return out
        for lo in range(0, len(x), 512):
            d = distances(x[lo : lo + 512], self.points)
            near = np.maximum(d, self.core).argmin(axis=1)
            reach = np.maximum(d, self.core)[np.arange(len(d)), near]
            found = self.labels[near]
            dense = (found >= 0) & (1 / np.maximum(reach, TINY) >= self.begins[found] if len(self.begins) else np.zeros(len(d), bool))
            same = d.argmin(axis=1)
            own = d[np.arange(len(d)), same] == 0
            out[lo : lo + 512] = np.where(own, self.labels[same], np.where(dense, found, -1))
        return out


def spanning_tree(x: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges of least mutual reachability that connect all rows, the shortest first."""
    n = len(x)
    best, via, out = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, bool)
    at, edges = 0, []
    out[0] = True
    for _ in range(n - 1):
        d = np.maximum(np.maximum(distances(x[at : at + 1], x)[0], core), core[at])
        closer = ~out & (d < best)
        best[closer], via[closer] = d[closer], at
        at = int(np.where(out, np.inf, best).argmin())
        out[at] = True
        edges.append((float(best[at]), int(via[at]), at))
    return sorted(edges)


def _bins(dist: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How many of a row's distances are in each of ``BINS`` parts of [lo, hi)."""
    width = _width(lo, hi)[:, None]
    at = np.clip(((dist - lo[:, None]) / width).astype(np.int64), 0, BINS - 1)
    at -= (at > 0) & (dist < lo[:, None] + at * width)  # a division may round where the edges don't
    at += (at < BINS - 1) & (dist >= lo[:, None] + (at + 1) * width)
    row, _ = np.nonzero(inside := (dist >= lo[:, None]) & (dist < hi[:, None]))
    return np.bincount(row * BINS + at[inside], minlength=len(dist) * BINS).reshape(len(dist), BINS)


def _width(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return np.maximum((hi - lo) / BINS, np.spacing(lo))


def core_distances(rows: DataFrame, features: list[str], least: int, size: int = BLOCK) -> DataFrame:
    """``rows`` (r and features) with ``core``: the distance to the ``least``-th other row.  All rows' distances are counted in bins of a range of each row's own, which holds the one that is looked for and is narrowed until it is one number."""
    d = len(features)
    spread = rows.agg(*[(F.max(c) - F.min(c)).alias(c) for c in features]).first()
    most = float(np.sqrt(sum((spread[c] or 0.0) ** 2 for c in features))) * 1.001 + 1.0
    packed = blocks(rows.select("r", *features, F.lit(0.0).alias("lo"), F.lit(most).alias("hi"), F.lit(0.0).alias("below")), [*features, "r", "lo", "hi", "below"], size, "r")
    width = d + 4

    def of(x: np.ndarray, y: np.ndarray, same: bool):
        dist = distances(x[:, :d], y[:, :d])
        return _bins(dist, x[:, d + 1], x[:, d + 2]), None if same else _bins(dist.T, y[:, d + 1], y[:, d + 2])

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, n, held, total in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                x = np.frombuffer(held.as_py()).reshape(-1, width).copy()
                run = np.cumsum(np.frombuffer(total.as_py()).reshape(len(x), BINS), axis=1) + x[:, d + 3, None]
                at = (run > least).argmax(axis=1)
                i, lo, hi = np.arange(len(x)), x[:, d + 1].copy(), x[:, d + 2].copy()
                w = _width(lo, hi)
                x[:, d + 1], x[:, d + 2] = lo + at * w, np.where(at == BINS - 1, hi, np.minimum(lo + (at + 1) * w, hi))
                x[:, d + 3] = np.where(at > 0, run[i, np.maximum(at - 1, 0)], x[:, d + 3])
                wide = int((x[:, d + 2] > np.maximum(np.nextafter(x[:, d + 1], np.inf), TINY)).sum())
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([n], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([wide], pa.int64())], names=["block", "n", "packed", "wide"])

    while True:
        summed = tile_sums(packed, width, of).select("block", "n", "packed", "total")
        found = staged(summed.mapInArrow(narrowed, "block int, n int, packed binary, wide long"), "cores")
        packed = found.select("block", "n", "packed")
        if not (found.agg(F.sum("wide")).first()[0] or 0):
            break

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for held in b.column(2):
                x = np.frombuffer(held.as_py()).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, d].astype(np.int64)), *[pa.array(x[:, k].copy()) for k in (*range(d), d + 1)]], names=["r", *features, "core"])

    return staged(packed.mapInArrow(unpack, f"r long, {', '.join(f'`{c}` double' for c in features)}, core double"), "cored")


def first_links(rows: DataFrame, features: list[str], size: int = BLOCK) -> DataFrame:
    """r, w, a, b, other: the edge that the first of Boruvka's rounds gives a row of rows (r, features, core), where it is no longer than the row's core distance; most rows have one.

    No edge of a row is shorter, and of those as long the one to the row of least number is the first: a row in reach whose own core distance isn't larger.  Rows look among the first ``size`` rows, and those that find none there among all.
    """
    d = len(features)
    columns = [*features, "core", "r"]
    chunks = blocks(rows, columns, size, "r", ranges=True)

    def least(x: np.ndarray, chunks: Iterator[np.ndarray]) -> list[np.ndarray]:
        best, step = np.full(len(x), np.inf), 64
        for y in chunks:
            for at in range(0, len(x), step):
                s = slice(at, at + step)
                near = np.maximum(distances(x[s, :d], y[:, :d]), y[None, :, d]) <= x[s, d, None]
                near &= x[s, d + 1, None] != y[None, :, d + 1]
                best[s] = np.minimum(best[s], np.where(near.any(axis=1), y[near.argmax(axis=1), d + 1], np.inf))
        return [x[:, d + 1].astype(np.int64), np.where(np.isfinite(best), best, -1).astype(np.int64)]

    found = staged(strips(blocks(rows, columns, size, "r"), chunks.orderBy("block").limit(1), least, d + 2, "r long, other long"), "links")
    rest = rows.join(found.filter("other < 0").select("r"), "r", "left_semi")
    late = staged(strips(blocks(rest, columns, max(1, size // 8), "r"), chunks, least, d + 2, "r long, other long"), "links")
    both = found.unionAll(late).filter("other >= 0").join(rows.select("r", "core"), "r")
    return both.select("r", F.col("core").alias("w"), F.least("r", "other").alias("a"), F.greatest("r", "other").alias("b"), "other")


def shared_tree(rows: DataFrame, features: list[str], size: int = BLOCK) -> DataFrame:
    """w, a, b: the edges of :func:`spanning_tree` of rows (r, features, core), by Boruvka's rounds: each component gets its shortest edge to another one, and what that joins becomes one.

    The first round is :func:`first_links`.  The others go tile by tile over pairs of rows of different components, without rows whose core distance is longer than what every component has an edge of.
    """
    d = len(features)
    rows = staged(rows.withColumn("comp", F.col("r")), "components")
    edges: list[DataFrame] = []

    def shortest(x: np.ndarray, y: np.ndarray, mutual: np.ndarray) -> np.ndarray:
        """Rows (component, w, a, b, other component): of each component of x the least (w, a, b); rows are in order of their numbers."""
        at = mutual.argmin(axis=1)
        w = mutual[np.arange(len(x)), at]
        out = np.column_stack([x[:, d + 1], w, np.minimum(x[:, d + 2], y[at, d + 2]), np.maximum(x[:, d + 2], y[at, d + 2]), y[at, d + 1]])[np.isfinite(w)]
        out = out[np.lexsort((out[:, 3], out[:, 2], out[:, 1], out[:, 0]))]
        new = np.ones(len(out), bool)
        new[1:] = out[1:, 0] != out[:-1, 0]
        return out[new]

    def apart(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Parts of both sides with their mutual reachability, infinite within a component: a component against the others, where those are few."""
        inside = np.unique(x[:, d + 1])
        for c in inside if len(inside) <= 8 else [None]:
            a, b = (x, y) if c is None else (x[x[:, d + 1] == c], y[y[:, d + 1] != c])
            if not len(a) or not len(b):
                continue
            mutual = np.maximum(np.maximum(distances(a[:, :d], b[:, :d]), a[:, d, None]), b[None, :, d])
            if c is None:
                mutual[a[:, d + 1, None] == b[None, :, d + 1]] = np.inf
            yield a, b, mutual

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py()).reshape(-1, d + 3) for v in (a, b))
                found = [np.zeros((0, 5))]
                for p, q, mutual in apart(x, y):
                    found.append(shortest(p, q, mutual))
                    if i != j:
                        found.append(shortest(q, p, mutual.T))
                out = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(out[:, k].astype(np.int64) if k != 1 else out[:, k].copy()) for k in range(5)], names=["comp", "w", "a", "b", "other"])

    def bound(x: np.ndarray, chunks: Iterator[np.ndarray]) -> list[np.ndarray]:
        found = [np.zeros((0, 5))] + [shortest(p, q, mutual) for y in chunks for p, q, mutual in apart(x, y)]
        out = np.concatenate(found)
        return [out[:, 0].astype(np.int64), out[:, 1]]

    def joined(rows: DataFrame, best: DataFrame) -> tuple[DataFrame, int]:
        """``rows`` with the components that the edges ``best`` make, and how many those are."""
        edges.append(staged(best.select("w", "a", "b").distinct(), "edges"))
        back = best.select(F.col("comp").alias("other"), F.col("other").alias("back"))
        up = best.join(back, "other", "left").select("comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other")).alias("up"))
        up = staged(rows.select("comp").distinct().join(up, "comp", "left").select("comp", F.coalesce("up", "comp").alias("up")), "up")
        while True:  # every component's root, in doubled steps
            above = up.select(F.col("comp").alias("up"), F.col("up").alias("next"))
            up = staged(up.join(above, "up").select("comp", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "up")
            if up.filter("moved").isEmpty():
                break
            up = up.select("comp", "up")
        rows = staged(rows.join(up.select("comp", "up"), "comp").drop("comp").withColumnRenamed("up", "comp"), "components")
        return rows, up.filter("comp = up").count()

    columns = [*features, "core", "comp", "r"]
    rows, left = joined(rows, staged(first_links(rows.drop("comp"), features, size).withColumnRenamed("r", "comp"), "shortest"))
    while left > 1:
        some = blocks(rows, columns, size, "r", ranges=True).orderBy("block").limit(1)
        bounds = strips(blocks(rows, columns, size, "r"), some, bound, d + 3, "comp long, w double").groupBy("comp").agg(F.min("w").alias("w"))
        known = bounds.agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w")).first()
        near = rows.filter(F.col("core") <= known["w"]) if known["n"] == left else rows
        found = tiles(blocks(near, columns, size, "r")).mapInArrow(nearest, "comp long, w double, a long, b long, other long")
        best = staged(found.groupBy("comp").agg(F.min(F.struct("w", "a", "b", "other")).alias("e")).select("comp", "e.*"), "shortest")
        rows, left = joined(rows, best)
    out = edges[0]
    for e in edges[1:]:
        out = out.unionAll(e)
    return out


def fit(x: np.ndarray, least: int) -> Hierarchy:
    """The hierarchy of clusters of ``least`` rows or more of a matrix."""
    n = len(x)
    if n <= least:
        return Hierarchy(x, np.zeros(n), np.full(n, -1), np.zeros(0))
    core = np.concatenate([np.partition(distances(x[lo : lo + 512], x), least, axis=1)[:, least] for lo in range(0, n, 512)])
    return Hierarchy(x, core, *condensed(n, spanning_tree(x, core), least))


def condensed(n: int, tree: list[tuple[float, int, int]], least: int, copies: np.ndarray | None = None, core: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Labels of n rows from the edges of their spanning tree, the shortest first, and the density at which each cluster begins.  A row may stand for ``copies`` of it, which part at its ``core`` distance."""
    # The dendrogram: node n + k joins two nodes at the k-th edge.
    root, size = list(range(n)), [1] * n if copies is None else copies.tolist()
    joined: list[tuple[int, int, float]] = []
    top = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for d, a, b in tree:
        a, b = find(a), find(b)
        joined.append((top[a], top[b], d))
        size.append(size[top[a]] + size[top[b]])
        root[b] = a
        top[a] = n + len(joined) - 1

    def rows(node: int) -> list[int]:
        held, stack = [], [node]
        while stack:
            k = stack.pop()
            if k < n:
                held.append(k)
            else:
                stack += joined[k - n][:2]
        return held

    # Condensed: a cluster goes on until both parts of a split are large enough.
    parent, begins, mass, left = [-1], [0.0], [0.0], np.zeros(n, np.int64)
    stack = [(2 * n - 2, 0)]
    while stack:
        node, c = stack.pop()
        if node < n:  # a row with as many copies as a cluster needs
            mass[c] += (1 / max(core[node], TINY) - begins[c]) * size[node]
            left[node] = c
            continue
        *both, d = joined[node - n]
        density = 1 / max(d, TINY)
        large = [k for k in both if size[k] >= least]
        for k in both:
            if len(large) == 2:
                mass[c] += (density - begins[c]) * size[k]
                parent.append(c)
                begins.append(density)
                mass.append(0.0)
                stack.append((k, len(parent) - 1))
            elif k in large:
                stack.append((k, c))
            else:
                mass[c] += (density - begins[c]) * size[k]
                left[rows(k)] = c
    # The clusters whose mass exceeds that of what they split into; never the root.
    below, chosen = np.zeros(len(parent)), np.zeros(len(parent), bool)
    for c in range(len(parent) - 1, 0, -1):
        chosen[c] = mass[c] >= below[c]
        below[parent[c]] += max(mass[c], below[c])
    owner = np.full(len(parent), -1)
    for c in range(1, len(parent)):
        up = owner[parent[c]]
        owner[c] = up if up >= 0 else c if chosen[c] else -1
    found = owner[left]
    _, first = np.unique(found[found >= 0], return_index=True)
    order = found[found >= 0][np.sort(first)]  # clusters are numbered by their first row
    number = {c: k for k, c in enumerate(order.tolist())}
    return np.array([number.get(c, -1) for c in found.tolist()]), np.array([begins[c] for c in order.tolist()])


def density_clusters(df: DataFrame, features: list[str], key: str, *, least: int = 20, share: float = 0.05, name: str = "cluster", size: int = BLOCK) -> DataFrame:
    """``df`` with the cluster of each row, -1 for noise and for rows that miss a feature.  A cluster has ``least`` rows and ``share`` of all at least; equal rows are one node with their number."""
    from trialweave.operators import stability  # which labels rows by this module

    base = staged(df.withColumn("__row", F.monotonically_increasing_id()), "rows")
    clean = [(F.col(c).cast("double") + 0.0).alias(f"f{k}") for k, c in enumerate(features)]
    whole = base.dropna(subset=features).select("__row", F.xxhash64(key).alias("h"), F.col(key).alias("k"), *clean)
    columns = [f"f{k}" for k in range(len(features))]
    whole = whole.filter(" and ".join(f"not isnan({c})" for c in columns))
    different = whole.groupBy(*columns).agg(F.min(F.struct("h", "k", "__row")).alias("first"), F.count(F.lit(1)).cast("double").alias("copies"))
    rows = dense_places(different.select("first.*", "copies", *columns), ["h", "k", "__row"], "r")
    n, m = (int(v or 0) for v in rows.agg(F.sum("copies"), F.count("*")).first())
    smallest = max(least, int(np.ceil(share * n)))
    if n <= smallest:
        return base.drop("__row").withColumn(name, F.lit(-1))
    cored = stability.weighted_cores(rows.select("r", *columns, "copies"), columns, ["copies"], smallest, size).withColumnRenamed("core0", "core")
    tree = shared_tree(cored.select("r", *columns, "core"), columns, size)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies, core, edges = np.ones(m, np.int64), np.zeros(m), []
        for batch in batches:
            for edge, w, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if edge:
                    edges.append((w, a, b))
                else:
                    core[a], copies[a] = w, b
        if edges:
            found = condensed(m, edges, smallest, copies, core)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(m)), pa.array(found.astype(np.int32))], names=["r", "c"])

    nodes = cored.select(F.lit(False).alias("edge"), F.col("core").alias("w"), F.col("r").alias("a"), F.col("copies").cast("long").alias("b"))
    both = nodes.unionByName(tree.select(F.lit(True).alias("edge"), "w", "a", "b"))
    labels = both.repartition(1).sortWithinPartitions("edge", "w", "a", "b").mapInArrow(label, "r long, c int")
    found = whole.join(rows.select(*columns, "r"), columns).join(labels, "r").select("__row", "c")
    return base.join(found, "__row", "left").select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("c", F.lit(-1)).alias(name))
