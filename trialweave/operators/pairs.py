"""All pairs of rows by distance, in tiles: rows are packed into blocks of bounded size, pairs of blocks are dealt to tasks, and each task adds up what its tile says of its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.plans.staging import staged

#: Rows of a block.
BLOCK = 1024
#: Blocks of :func:`silhouettes`, if they'd have ``BLOCK`` rows or more: each row and its sums are shuffled once for each of them.
MOST = 16

#: Rows that are paired at a time; the part of a row's squared length below which a squared distance is short.
STEP, SHORT = 32, 1e-2
#: Rows of the same labels, on average, from which they are added up first.
FEW = 12


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, column by column: exact zeros for equal rows, and the same number from either side."""
    out = squares(a, b)
    return np.sqrt(out, out=out)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The squares of :func:`distances`."""
    out, part = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    for k in range(a.shape[1]):
        np.subtract(a[:, k, None], b[None, :, k], out=part)
        np.multiply(part, part, out=part)
        out += part
    return out


def spread(b: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """:func:`distances` to ``b`` by a product of matrices; those that are short beside the rows' own lengths, where it would lose digits, are taken as there."""
    centre = b.mean(axis=0)
    y = b - centre
    right = np.concatenate([-2 * y, np.ones((len(y), 1)), (y * y).sum(axis=1)[:, None]], axis=1).T.copy()

    def of(a: np.ndarray) -> np.ndarray:
        x = a - centre
        norm = (x * x).sum(axis=1)[:, None]
        out = np.concatenate([x, norm, np.ones((len(x), 1))], axis=1) @ right
        short = out < SHORT * norm
        if short.any():
            i, j = np.nonzero(short)
            out[i, j] = ((a[i] - b[j]) ** 2).sum(axis=1)
        return np.sqrt(out, out=out)

    return of


def blocks(df: DataFrame, columns: list[str], size: int = BLOCK, row: str | None = None, ranges: bool = False) -> DataFrame:
    """block, n, packed: ``columns`` as doubles, row by row, of blocks of about ``size`` rows, dealt by a hash of the rows' numbers and in their order (``row``, else numbers of their own); with ``ranges`` each block has ``size`` numbers that follow."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    numbered = staged(df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)], number.alias("r")), "rows")
    parts = max(1, -(-numbered.count() // size))
    place = F.floor(F.col("r") / size) if ranges else F.pmod(F.xxhash64("r"), F.lit(parts))
    dealt = numbered.withColumn("block", place.cast("int")).repartition("block").sortWithinPartitions("block", "r")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def made() -> pa.RecordBatch:
            x = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "n", "packed"])

        for b in batches:
            at = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            x = np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(len(columns))]) if len(at) else np.zeros((0, len(columns)))
            for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))(np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1, [len(at)])).tolist()), strict=True):
                if hi == lo:
                    continue
                if at[lo] != now and held:
                    yield made()
                    held = []
                now = int(at[lo])
                held.append(x[lo:hi])
        if held:
            yield made()

    return staged(dealt.select(*[f"c{k}" for k in range(len(columns))], "block").mapInArrow(pack, "block int, n int, packed binary"), "blocks")


def tiles(packed: DataFrame) -> DataFrame:
    """i, j, a, b: the rows of every two blocks, and of each with itself."""
    left = packed.select(F.col("block").alias("i"), F.col("packed").alias("a"))
    right = packed.select(F.col("block").alias("j"), F.col("packed").alias("b"))
    names = packed.select("block")
    pairs = names.toDF("i").join(names.toDF("j"), F.col("i") <= F.col("j")).repartition("i", "j")
    return pairs.join(left, "i").join(right, "j").select("i", "j", "a", "b")


def strips(packed: DataFrame, chunks: DataFrame, of: Callable[[np.ndarray, Iterator[np.ndarray]], list[np.ndarray]], width: int, kinds: str) -> DataFrame:
    """Columns ``kinds`` of ``of(rows, chunks)`` for the rows of each block of ``packed``; a task makes a pass over all ``chunks``, which come in any order and are neither broadcast nor held."""
    parts = max(1, packed.count())
    left = packed.select(F.col("block").alias("i"), F.col("packed").alias("a")).repartition(parts, "i")
    pairs = left.hint("shuffle_replicate_nl").crossJoin(chunks.select(F.col("packed").alias("b")).repartition(1))
    fields = [f.split() for f in kinds.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Scalar, pa.Scalar]]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, strip in groupby(rows(batches), key=lambda r: r[0]):
            _, a, b = next(strip)
            others = (np.frombuffer(v.as_py()).reshape(-1, width) for v in chain([b], (r[2] for r in strip)))
            out = of(np.frombuffer(a.as_py()).reshape(-1, width), others)
            for _ in strip:
                pass
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64() if kind == "long" else pa.float64()) for c, (_, kind) in zip(out, fields, strict=True)], names=[n for n, _ in fields])

    return pairs.mapInArrow(work, kinds)


def tile_sums(packed: DataFrame, width: int, of: Callable[[np.ndarray, np.ndarray, bool], tuple[np.ndarray, np.ndarray | None]]) -> DataFrame:
    """block, n, packed, total: the sum over all blocks of ``of(rows, others, same block)``, which gives an array for the rows and, of two blocks, one for the others."""
    rows = tiles(packed)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py()).reshape(-1, width) for v in (a, b))
                mine, theirs = of(x, y, i == j)
                out = [(i, mine)] if theirs is None else [(i, mine), (j, theirs)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([v.astype(float).tobytes() for _, v in out], pa.binary())], names=["block", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for b in batches:
            for block, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = np.frombuffer(part.as_py())
                if block != now and now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "total"])
                    total = None
                now, total = block, v.copy() if total is None else total + v
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "total"])

    parts = rows.mapInArrow(work, "block int, part binary").repartition("block").sortWithinPartitions("block")
    return packed.join(parts.mapInArrow(add, "block int, total binary"), "block")


def silhouettes(df: DataFrame, features: list[str], labels: list[str], size: int = BLOCK) -> DataFrame:
    """labelling, n, clusters, silhouette: the mean silhouette by Euclidean distance of each column of ``labels``; rows without a feature or a label don't count in it, a single cluster has none.

    Equal rows of equal labels are one row with their number.  The others are paired in ``MOST`` blocks by parts of ``size`` rows, so what is shuffled grows with the rows; the work is the square of the different ones.
    """
    counts = df.dropna(subset=features).groupBy(*features, *labels).agg(F.count(F.lit(1)).cast("double").alias("__copies"))
    whole = staged(counts, "different")
    names = {c: sorted(r[0] for r in whole.select(c).distinct().collect() if r[0] is not None) for c in labels}  # a row a cluster
    coded = [F.coalesce(F.create_map(*[F.lit(v) for k, n in enumerate(names[c]) for v in (n, float(k))])[F.col(c)], F.lit(-1.0)) if names[c] else F.lit(-1.0) for c in labels]
    columns = [*features, *[f"l{k}" for k in range(len(labels))], "__copies"]
    packed = blocks(whole.select(*features, *[x.alias(f"l{k}") for k, x in enumerate(coded)], "__copies"), columns, max(size, -(-whole.count() // MOST)))
    d, width, most = len(features), len(columns), [len(names[c]) for c in labels]
    counted = whole.agg(*[F.coalesce(F.sum(F.when(x == float(j), F.col("__copies"))), F.lit(0.0)).alias(f"n{k}_{j}") for k, x in enumerate(coded) for j in range(most[k])]).first() if sum(most) else None
    sizes = [np.array([counted[f"n{k}_{j}"] for j in range(most[k])], float) for k in range(len(labels))]

    def hot(rows: np.ndarray) -> np.ndarray:
        """A column a cluster of each labelling: whether a row is in it."""
        return np.concatenate([np.equal.outer(rows[:, d + k], np.arange(most[k])).astype(float) for k in range(len(labels))], axis=1)

    def grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order in which rows of the same labels stand together, each one's group there, and :func:`hot` of the groups."""
        groups, of = np.unique(rows[:, d:-1], axis=0, return_inverse=True)
        order = np.argsort(of, kind="stable")
        return order, of.reshape(-1)[order], hot(np.column_stack([np.zeros((len(groups), d)), groups, np.ones(len(groups))]))

    def unsorted(order: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.empty_like(rows)
        out[order] = rows
        return out

    def of(x: np.ndarray, y: np.ndarray, same: bool):
        """Sums of distances to the clusters of each labelling: those to rows of the same labels are added up once for all labellings."""
        order_x, group_x, hot_x = grouped(x)
        order_y, group_y, hot_y = grouped(y)
        x, y = x[order_x], y[order_y]
        mine, theirs = np.zeros((len(x), sum(most))), np.zeros((len(y), sum(most)))
        if FEW * max(len(hot_x) / len(x), len(hot_y) / len(y)) > 1:  # hardly any rows have the same labels
            in_x, in_y = hot_x[group_x] * x[:, -1:], hot_y[group_y] * y[:, -1:]
            for at in range(0, len(y), size):
                t = slice(at, at + size)
                near = spread(y[t, :d])
                for lo in range(0, len(x), 8 * STEP):
                    s = slice(lo, lo + 8 * STEP)
                    dist = near(x[s, :d])
                    mine[s] += dist @ in_y[t]
                    if not same:
                        theirs[t] += dist.T @ in_x[s]
            return unsorted(order_x, mine), None if same else unsorted(order_y, theirs)
        single_x, single_y = (x[:, -1] == 1).all(), (y[:, -1] == 1).all()
        for at in range(0, len(y), size):
            t = slice(at, at + size)
            near = spread(y[t, :d])
            starts = np.flatnonzero(np.diff(group_y[t], prepend=-1))
            known, column = hot_y[group_y[t][starts]], np.zeros((len(hot_x), len(y[t])))
            for lo in range(0, len(x), STEP):
                s = slice(lo, lo + STEP)
                dist = near(x[s, :d])
                mine[s] += np.add.reduceat(dist if single_y else dist * y[t, -1], starts, axis=1) @ known
                if not same:
                    first = np.flatnonzero(np.diff(group_x[s], prepend=-1))
                    column[group_x[s][first]] += np.add.reduceat(dist if single_x else dist * x[s, -1:], first, axis=0)
            if not same:
                theirs[t] += column.T @ hot_x
        return unsorted(order_x, mine), None if same else unsorted(order_y, theirs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, total in zip(b.column(2), b.column(3), strict=True):
                x = np.frombuffer(rows.as_py()).reshape(-1, width)
                sums = np.frombuffer(total.as_py()).reshape(len(x), -1)
                at, out = 0, []
                for k, n in enumerate(sizes):
                    part, own = sums[:, at : at + len(n)], x[:, d + k].astype(int)
                    at += len(n)
                    on = np.flatnonzero(own >= 0)
                    if len(n) < 2 or not len(on):
                        continue
                    own, part, copies = own[on], part[on], x[on, -1]
                    i = np.arange(len(on))
                    a = part[i, own] / np.maximum(n[own] - 1, 1)
                    mean = part / n
                    mean[i, own] = np.inf
                    near = mean.min(axis=1)
                    s = np.where(n[own] > 1, (near - a) / np.maximum(np.maximum(a, near), 1e-300), 0)
                    out.append((k, int(copies.sum()), float((s * copies).sum())))
                yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.float64()))], names=["k", "n", "s"])

    spark = df.sparkSession
    listed = spark.createDataFrame([(k, c, most[k]) for k, c in enumerate(labels)], "k int, labelling string, clusters int")
    if not sum(most):
        return listed.select("labelling", F.lit(0).cast("long").alias("n"), "clusters", F.lit(None).cast("double").alias("silhouette"))
    found = tile_sums(packed, width, of).mapInArrow(score, "k int, n long, s double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return listed.join(found, "k", "left").select("labelling", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "clusters", (F.col("s") / F.col("n")).alias("silhouette"))
