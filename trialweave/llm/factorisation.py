"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a text is ``sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``.  Each word occurrence is a feature of value 1 / sqrt(n),
each statistic one of its standardised value; pairs are scored in time linear in the features by
``sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)``.

Fitting takes the ``max_train`` labelled ids of smallest hash, as many of them as have ``max_train_bytes`` of text (documented bounds); their features are made by tasks over whole texts and the
model is fitted on the driver by mini-batch AdaGrad.  Scoring is one pass over all texts, without a shuffle.

Defined cases: null and empty texts have no words and get a score from bias and statistics; texts of any length are scored whole; null metadata counts as 0; rows without a
label aren't fitted to; without any label every score is 0.5; repeated rows get the same score, and of a repeated labelled id the least text and the least label are fitted to once; a score of 0.5 (a tie)
is predicted 1; a null id isn't held out, ids may be of any type with an order; an empty table gives an empty result; other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.text import numbered, place
from trialweave.llm.words import U64, blocks, hashes, mix, spans
from trialweave.plans.staging import staged

SLOTS = 1 << 16
FACTORS = 8
MAX_TRAIN = 6000
MAX_TRAIN_BYTES = 200_000_000
#: Share of bytes by kind, then sizes and repetition.
STATISTICS = ("symbols", "digits", "upper", "beyond_ascii", "punctuation", "words", "word_length", "lines", "distinct_words", "distinct_windows", "short_words")
_KIND = np.zeros((5, 256), dtype=np.uint8)
_KIND[0, list(b"#*$%&|<>{}[]\\^~_=+@`")] = 1
_KIND[1, list(b"0123456789")] = 1
_KIND[2, 65:91] = 1
_KIND[3, 128:] = 1
_KIND[4, list(b".,;:!?'\"()-")] = 1


def _per_row(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return run[edges[1:]] - run[edges[:-1]]


def _distinct(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many distinct values each row has."""
    row = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))
    by = np.lexsort((values, row))
    v, r = values[by], row[by]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=len(first) - 1)


def featured(texts: pa.Array, metadata: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word slots, index of each row's first word, statistics with metadata) of runs of rows."""
    with np.errstate(over="ignore"):
        for lo, hi, buf, offs in blocks(texts, lower=False):
            starts, ends, first = spans(buf, offs)
            words = hashes(buf, starts, ends)
            n = np.diff(first)
            size = np.maximum(np.diff(offs), 1)
            kinds = [_per_row(k[buf], offs) / size for k in _KIND]
            many = np.maximum(n, 1)
            lines = _per_row(buf == 10, offs) + 1
            lens = ends - starts
            if len(words) > 2:
                windows = (words[:-2] * U64(0xBF58476D1CE4E5B9) + words[1:-1]) * U64(0xBF58476D1CE4E5B9) + words[2:]
                windows = np.append(windows, words[-2:])  # the last two of a row are windows over its end, distinct in nearly every text
            else:
                windows = words
            stats = [*kinds, np.log1p(n), _per_row(lens, first) / many, np.log1p(n / lines), _distinct(words, first) / many, _distinct(windows, first) / many, _per_row(lens <= 3, first) / many]
            stats = np.column_stack([*stats, np.log1p(np.maximum(metadata[lo:hi], 0))]) if metadata.shape[1] else np.column_stack(stats)
            yield lo, hi, (mix(words) & U64(SLOTS - 1)).astype(np.int32), first, stats.astype(np.float32)


@dataclass
class Machine:
    """w0, w and V over SLOTS word slots followed by the statistics, and the scaling of those."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scores(self, slots: np.ndarray, first: np.ndarray, stats: np.ndarray) -> np.ndarray:
        z, *_ = self._sums(slots, first, np.clip((stats - self.mean) / self.scale, -4, 4))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _sums(self, slots: np.ndarray, first: np.ndarray, x: np.ndarray):
        n = np.diff(first)
        value = (1 / np.sqrt(np.maximum(n, 1))).astype(np.float32)
        d = len(n)
        linear, total, squares = np.zeros(d), np.zeros((d, self.factors.shape[1])), np.zeros(d)
        some = np.flatnonzero(n)
        if len(some):
            for k in range(self.factors.shape[1]):
                v = self.factors[slots, k]
                total[some, k] = np.add.reduceat(v, first[some], dtype=np.float64) * value[some]
            own = (self.factors[:SLOTS] ** 2).sum(axis=1)
            squares[some] = np.add.reduceat(own[slots], first[some], dtype=np.float64) * value[some] ** 2
            linear[some] = np.add.reduceat(self.linear[slots], first[some], dtype=np.float64) * value[some]
        v = self.factors[SLOTS:]
        total += x @ v
        squares += x**2 @ (v**2).sum(axis=1)
        linear += x @ self.linear[SLOTS:]
        return self.bias + linear + 0.5 * ((total**2).sum(axis=1) - squares), total, value


def fit(slots: list[np.ndarray], stats: np.ndarray, labels: np.ndarray, *, factors: int = FACTORS, epochs: int = 12, rate: float = 0.1, decay: float = 1e-3, seed: int = 0) -> Machine:
    rng = np.random.default_rng(seed)
    p = stats.shape[1]
    mean = stats.mean(axis=0) if len(stats) else np.zeros(p)
    scale = np.maximum(stats.std(axis=0), 1e-3) if len(stats) else np.ones(p)
    m = Machine(0.0, np.zeros(SLOTS + p, np.float32), rng.normal(0, 0.02, (SLOTS + p, factors)).astype(np.float32), mean, scale)
    if not len(labels):
        m.factors[:] = 0
        return m
    x_all = np.clip((stats - mean) / scale, -4, 4)
    g_bias, g_linear, g_factors = 1e-6, np.full(SLOTS + p, 1e-6, np.float32), np.full((SLOTS + p, factors), 1e-6, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), 64):
            rows = order[lo : lo + 64]
            n = np.array([len(slots[i]) for i in rows])
            flat = np.concatenate([slots[i] for i in rows])
            first = np.concatenate(([0], np.cumsum(n)))
            x = x_all[rows]
            z, total, value = m._sums(flat, first, x)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) / len(rows)
            g = err.sum()
            g_bias += g * g
            m.bias -= rate * g / np.sqrt(g_bias)
            row = np.repeat(np.arange(len(rows)), n)
            use, at = np.unique(flat, return_inverse=True)
            xs = value[row]
            grad_w = np.bincount(at, err[row] * xs, minlength=len(use))
            weight = np.bincount(at, err[row] * xs**2, minlength=len(use))
            grad_v = np.column_stack([np.bincount(at, err[row] * xs * total[row, k], minlength=len(use)) for k in range(factors)]) if len(use) else np.zeros((0, factors))
            grad_v -= weight[:, None] * m.factors[use]
            stat_w = x.T @ err
            stat_v = x.T @ (err[:, None] * total) - (x**2).T @ err[:, None] * m.factors[SLOTS:]
            use = np.concatenate([use, np.arange(SLOTS, SLOTS + p)])
            grad_w = np.concatenate([grad_w, stat_w]) + decay * m.linear[use]
            grad_v = np.concatenate([grad_v, stat_v]) + decay * m.factors[use]
            g_linear[use] += grad_w**2
            g_factors[use] += grad_v**2
            m.linear[use] -= rate * grad_w / np.sqrt(g_linear[use])
            m.factors[use] -= rate * grad_v / np.sqrt(g_factors[use])
    return m


def held_out(id_col: Column) -> Column:
    """The rows whose crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _columns(batch: pa.RecordBatch, start: int) -> np.ndarray:
    cols = [batch.column(i).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False) for i in range(start, batch.num_columns)]
    return np.column_stack(cols) if cols else np.zeros((batch.num_rows, 0))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, text, metadata -> label, slots, stats."""
    for b in batches:
        for lo, hi, slots, first, stats in featured(b.column(1), _columns(b, 2)):
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo).cast(pa.int32()), pa.array([slots[a:z].tobytes() for a, z in zip(first[:-1], first[1:], strict=True)], pa.binary()), pa.array([s.tobytes() for s in stats], pa.binary())],
                names=["label", "slots", "stats"],
            )


def train(labelled: DataFrame, **how) -> Machine:
    """A machine fitted to all rows (label, text, metadata): a sample of bounded size, see :func:`sample`."""
    width = len(STATISTICS) + len(labelled.columns) - 2
    rows = labelled.mapInArrow(_features, "label int, slots binary, stats binary").collect()
    rows.sort(key=lambda r: (bytes(r["slots"]), bytes(r["stats"]), r["label"]))
    stats = np.array([np.frombuffer(r["stats"], np.float32) for r in rows]).reshape(-1, width)
    return fit([np.frombuffer(r["slots"], np.int32) for r in rows], stats, np.array([r["label"] for r in rows], dtype=np.float64), **how)


def sample(labels: DataFrame, id_col: str, label_col: str, max_train: int = MAX_TRAIN) -> DataFrame:
    """i, label: the ``max_train`` ids of smallest hash, so few that they may be broadcast; of several labels of an id the least."""
    one = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.min(label_col).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("i"), "i").limit(max_train)


def labelled_rows(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, metadata: list[str], max_bytes: int) -> DataFrame:
    """label, text, metadata of the sample's ids, a row an id (of repeated ones the least text), while their texts, in order of the hash, have at most ``max_bytes``."""
    rows = docs.join(F.broadcast(known), F.col(id_col) == F.col("i")).select("i", "label", F.struct(F.col(text_col).cast("string").alias("text"), *[F.col(c).cast("double").alias(f"m{k}") for k, c in enumerate(metadata)]).alias("x"))
    one = staged(rows.groupBy("i").agg(F.first("label").alias("label"), F.min("x").alias("x")), "labelled")
    size = F.coalesce(F.octet_length("x.text"), F.lit(0)).cast("long")
    upto = one.select("i", F.sum(size).over(Window.orderBy(F.xxhash64("i"), "i")).alias("bytes")).filter(F.col("bytes") <= max_bytes)  # ids and sizes only
    return one.join(F.broadcast(upto.select("i")), "i").select("label", "x.*")


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows)
            for lo, hi, slots, first, stats in featured(b.column(2), _columns(b, 3)):
                out[lo:hi] = model.value.scores(slots, first, stats)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], names=["id", "held_out", "score"])

    return run


def quality_scores(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: tuple[str, ...] = ("n_chars",),
    max_train: int = MAX_TRAIN, max_train_bytes: int = MAX_TRAIN_BYTES,
) -> DataFrame:
    """For each row the id, ``held_out``, ``score`` and ``predicted``; held-out rows aren't fitted to."""
    rows, (doc, text, *extra), _ = numbered(docs, (), id_col, text_col, *metadata)
    marks, (mark, label), _ = numbered(labels, (), id_col, label_col)
    known = staged(sample(marks.filter(~held_out(F.col(mark))), mark, label, max_train), "known")
    model = docs.sparkSession.sparkContext.broadcast(train(labelled_rows(rows, known, doc, text, extra, max_train_bytes)))
    kind = docs.schema[place(docs, id_col)].dataType.simpleString()
    slim = rows.select(F.col(doc).alias("id"), held_out(F.col(doc)).alias("held_out"), F.col(text).cast("string").alias("text"), *[F.col(c).cast("double") for c in extra])
    scored = slim.mapInArrow(_scorer(model), f"id {kind}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
