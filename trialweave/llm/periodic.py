"""Runs: stretches of words that repeat with a period, found by comparing a document's word ids with every shift of themselves.

The ids of many documents lie in one array, longest first and never equal across documents, so one comparison with a shift serves all documents
that are long enough for it.  Small shifts are compared in full and their true stretches run-length coded.  A run of a larger period q makes
q true words in a row, so windows of eight ids are compared at every (q - 7)th word first, and a stretch is measured from each hit: n words cost n log n probes over all shifts.
Hits inside a run whose period divides the shift are no new runs (Fine and Wilf) and aren't measured.

A text of up to ``2 * lags`` words is searched where it is read.  A longer one is dealt to tasks by ranges of lags, which carry its ids; what they find meets again by document.
Runs of a document are fewer than its words, so a document's result is as large as its text at most.

Defined cases: null and empty texts have no words, no runs and an empty collapsed text; a text of any length is searched whole;
the longest of runs is the first of equal ones, then the one of smallest period; repeated rows and null ids are rows as any other; an empty table gives an
empty result; columns beside id and text aren't read, whatever their names.  :func:`echoed` leaves rows with a null id as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.text import SPACE_CLASS, let, numbered, whole
from trialweave.plans.staging import staged

#: A run has so many words at least, and twice its period.
LEAST = 12
#: Shifts that one task searches of one document.
LAGS = 1 << 16
#: Shifts below this are compared in full.
SMALL = 16
WINDOW = 8
#: So many bytes of texts share an array.
TOGETHER = 4_000_000
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the true stretches."""
    at = np.flatnonzero(equal)
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) != 1)
    return at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))] + 1


def _measured(g: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """The stretch of words around i that equal those q further on."""
    lo, step = i, 64
    while lo > 0:
        a = max(0, lo - step)
        other = np.flatnonzero(g[a:lo] != g[a + q : lo + q])
        if len(other):
            lo = a + int(other[-1]) + 1
            break
        lo, step = a, 4 * step
    hi, step, last = i, 64, len(g) - q
    while hi < last:
        b = min(last, hi + step)
        other = np.flatnonzero(g[hi:b] != g[hi + q : b + q])
        if len(other):
            hi += int(other[0])
            break
        hi, step = b, 4 * step
    return lo, hi


def find_runs(g: np.ndarray, sizes: np.ndarray, least: int = LEAST, lags: tuple[int, int] = (1, 1 << 62)) -> np.ndarray:
    """Rows (start, end, period), without those whose period isn't the smallest, of documents of descending ``sizes`` one after another in ``g``.
    Of periods in ``lags`` only; then a row may stay that has a smaller period outside of them."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    longest = int(sizes[0]) if len(sizes) else 0
    reach = np.zeros(len(g), np.int64)  # the end of the run found there that reaches furthest
    period = np.ones(len(g), np.int64)
    found: list[tuple[int, int, int]] = []

    def note(s: int, e: int, q: int) -> None:
        if lags[0] <= q < lags[1]:
            found.append((s, e, q))
        new = reach[s:e] < e
        period[s:e][new] = q
        reach[s:e][new] = e

    def long_enough(q: int) -> int:
        """Words of the documents in which a run of period q fits."""
        return int(total[np.searchsorted(-sizes, -max(least, 2 * q), side="right")])

    for q in range(1, min(SMALL, longest // 2 + 1, lags[1])):
        n = long_enough(q)
        starts, ends = _stretches(g[: n - q] == g[q:n]) if n > q else ((), ())
        for s, e in zip(starts, ends, strict=True):
            if e - s >= max(least, 2 * q) - q:
                note(int(s), int(e) + q, q)
    if longest // 2 >= SMALL:
        h = np.zeros(max(len(g) - WINDOW + 1, 0), np.int64)
        with np.errstate(over="ignore"):
            for j in range(WINDOW):
                h = h * np.int64(6364136223846793005) + g[j : j + len(h)]
    for q in range(max(SMALL, lags[0]), min(longest // 2 + 1, lags[1])):
        n = long_enough(q) - q - WINDOW + 1
        if n <= 0:
            break
        step = q - WINDOW + 1
        hits = np.flatnonzero(h[0:n:step] == h[q : q + n : step])
        if not len(hits):
            continue
        hits *= step
        done = 0
        for i in hits[(reach[hits] <= hits + q) | (q % period[hits] != 0)].tolist():
            if i < done:
                continue
            s, e = _measured(g, i, q)
            done = e
            if e - s >= max(least, 2 * q) - q:
                note(s, e + q, q)
    if not found:
        return np.zeros((0, 3), np.int64)
    out = np.array(found, np.int64)
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:, 0] != out[:-1, 0]) | (out[1:, 1] != out[:-1, 1])
    return out[new]


def _ids(words: list[bytes]) -> np.ndarray:
    """For each word the place of its first occurrence."""
    first: dict[bytes, int] = {}
    return np.fromiter(map(first.setdefault, words, range(len(words))), np.int64, len(words))


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without the repeats of the runs' first periods."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    return b" ".join(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))


def _rows(ids: list[pa.Array], counts: list[int], runs: list[np.ndarray], texts: list[bytes]) -> pa.RecordBatch:
    flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
    parts = [pa.array(flat[:, 0].copy()), pa.array(flat[:, 1] - flat[:, 0]), pa.array(flat[:, 2].copy())]
    ends = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32))
    listed = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
    return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(counts, pa.int64()), listed, pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])


def _search(least: int):
    """id, text -> id, n_words, runs, collapsed of whole texts."""

    def some(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        words = [t.split() for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-sizes, kind="stable")
        total = np.concatenate(([0], np.cumsum(sizes[order])))
        g = np.concatenate([_ids(words[k]) + at for k, at in zip(order.tolist(), total.tolist(), strict=False)])
        found = find_runs(g, sizes[order], least)
        which = np.searchsorted(total, found[:, 0], side="right") - 1
        found[:, :2] -= total[which][:, None]
        cut = np.searchsorted(which, np.arange(len(order) + 1))
        runs = [found[:0]] * len(order)
        for place, k in enumerate(order.tolist()):
            runs[k] = found[cut[place] : cut[place + 1]]
        return _rows([ids], sizes.tolist(), runs, [_collapsed(w, r) for w, r in zip(words, runs, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            lo, size = 0, 0
            for k, t in enumerate(texts):
                size += len(t)
                if size >= TOGETHER or k == len(texts) - 1:
                    yield some(b.column(0).slice(lo, k + 1 - lo), texts[lo : k + 1])
                    lo, size = k + 1, 0

    return run


def _ranges(lags: int):
    """row, text -> row, lo, hi, ids: a row for each range of lags of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                words = text.as_py().split()
                ids = zstandard.ZstdCompressor().compress(_ids(words).tobytes())
                for lo in range(1, len(words) // 2 + 1, lags):
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([lo], pa.int64()), pa.array([lo + lags], pa.int64()), pa.array([ids], pa.binary())], names=["row", "lo", "hi", "ids"])

    return run


def _in_range(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, lo, hi, ids in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                g = np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), np.int64)
                found = find_runs(g, np.array([len(g)]), least, (lo, hi))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row)), *[pa.array(found[:, k].copy()) for k in range(3)]], names=["row", "s", "e", "q"])

    return run


def _assemble(id_type: pa.DataType):
    """One long document and its runs -> id, n_words, runs, collapsed."""

    def run(docs: pa.Table, runs: pa.Table) -> pa.Table:
        found = np.stack([runs.column(c).to_numpy() for c in ("s", "e", "q")], axis=1).astype(np.int64) if runs.num_rows else np.zeros((0, 3), np.int64)
        found = found[np.lexsort((found[:, 2], found[:, 0]))]
        docs = docs.combine_chunks().to_batches()[0]
        words = docs.column("text").cast(pa.binary())[0].as_py().split()
        return pa.Table.from_batches([_rows([docs.column("id").cast(id_type)], [len(words)], [found], [_collapsed(words, found)])])

    return run


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, lags: int = LAGS) -> DataFrame:
    """For each row the id, ``n_words``, ``runs`` (start, length, period, by start and period) and ``collapsed``: the words that are in no run or in its first period."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    named, (doc, text), _ = numbered(docs, (), id_col, text_col)
    kind = named.schema[doc].dataType
    rows = named.select(F.col(doc).alias("id"), whole(F.col(text)).alias("text"))
    schema = f"id {kind.simpleString()}, n_words long, runs {_RUNS}, collapsed string"
    # a word takes two bytes at least, with the space before it
    short = rows.filter(F.octet_length("text") < 4 * lags).mapInArrow(_search(least), schema)
    long = staged(rows.filter(F.octet_length("text") >= 4 * lags).withColumn("row", F.monotonically_increasing_id()), "long_texts")
    if long.isEmpty():
        return short.withColumnRenamed("id", id_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = long.select("row", "text").mapInArrow(_ranges(lags), "row long, lo long, hi long, ids binary").repartition(parts, "row", "lo")
    runs = pieces.mapInArrow(_in_range(least), "row long, s long, e long, q long").groupBy("row", "s", "e").agg(F.min("q").alias("q"))
    far = long.groupBy("row").cogroup(runs.groupBy("row")).applyInArrow(_assemble(to_arrow_type(kind)), schema)
    return short.unionAll(far).withColumnRenamed("id", id_col)


def echoed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (id and text) with a repeated tail in a tenth of the texts, chosen by the checksum of the id: a known load of runs."""
    named, (doc, text), _ = numbered(docs, (), id_col, text_col)
    h = F.crc32(F.col(doc).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(whole(F.col(text)), SPACE_CLASS + "+"), lambda w: w != "")

    def repeated(w):
        a = F.pmod(g, F.size(w)).cast("int")
        p = (1 + F.floor((F.size(w) - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))), " ")

    marked = (h % 10 == 0) & (F.length(F.btrim(whole(F.col(text)), F.lit(" \t\n\x0b\x0c\r"))) > 0)
    return named.select(F.col(doc).alias(id_col), F.when(marked, let(words, repeated)).otherwise(whole(F.col(text))).alias(text_col))


def digest(found: DataFrame) -> DataFrame:
    """The longest run and checksums of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.n").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.n") / -F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
