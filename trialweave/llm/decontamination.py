"""Benchmark decontamination: every passage of every text queries a BM25 index of the test items by block-max WAND.

*Index.*  A term's impact on an item is its BM25 weight divided by the item's score for itself, so one threshold
serves items of any length (1: all of the item's terms are there).  Posting lists are in order of item, cut into blocks at the same items (``BLOCK_ITEMS``), each with its largest impact,
so memory follows the postings.  The index goes to the tasks in shards of about ``shard_bytes`` of item text;
each shard is a pass over the texts, with statistics and passages of all items, so shards change no result.
*Passages.*  Windows of 64, 128, 256, ... words, half a window apart, over whole texts; an item is looked for in the smallest that are twice as long as it, so a leaked item lies whole in one
and no item changes what another finds.
*Search.*  The bound of a block is the sum of its maxima in the lists of the window's distinct terms.  Blocks whose bound doesn't reach the threshold are skipped (their bounds are
summed for many windows at once); the lists' cursors move from live block to live block, and by WAND within one: items are scored only where the bounds of
the lists up to the pivot reach the threshold.  Everything above it is retrieved, no top k.
*Verification.*  The item's question and answer (the last sentence, or the last third) must both be there: the share of their 3-word shingles found in the passage
is at least ``overlap`` for each.  Of an item of fewer than ``SHORT_WORDS`` words all words must stand in the passage in a row.

Words are runs of letters and digits, lower-cased.  Defined cases: null and empty texts and items, and those without a word, match nothing; texts of any length are searched whole; an item of one word
is found wherever the word stands; repeated items and documents each count; of passages of one text with the same item the one of the highest score is told, of equal ones (ties) the one of the larger overlaps, then the
later one; rows with null ids are searched as any other, ids of documents and items may be of any type with an order; empty tables give an empty result; other columns of documents stay
as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trialweave.llm.text import numbered, place
from trialweave.llm.words import PUNCTUATION, U64, blocks, hashes, mix, spans

K1, B = 1.2, 0.75
BLOCK_ITEMS = 4
THRESHOLD = 0.5
OVERLAP = 0.5
SHORT_WORDS = 8
#: Ten times as much memory in each task.
SHARD_BYTES = 16_000_000


def _lowered(texts: pa.Array) -> pa.Array:
    return pa.array([x.lower() if x else "" for x in texts.to_pylist()], pa.large_string())


def text_words(text: str) -> np.ndarray:
    with np.errstate(over="ignore"):
        for _, _, buf, offs in blocks(_lowered(pa.array([text])), lower=False):
            starts, ends, _ = spans(buf, offs, PUNCTUATION)
            return hashes(buf, starts, ends)
    return np.zeros(0, U64)


def parts(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence is the answer if both keep a fourth of the text, else the last third of the words."""
    cuts = [m.end() for m in re.finditer(r"[.?!:]\s+|\n", text.strip())]
    text = text.strip()
    for at in reversed(cuts):
        if len(text) / 4 <= at <= len(text) * 3 / 4:
            return text[:at], text[at:]
    words = text.split()
    k = len(words) - max(1, len(words) // 3)
    return " ".join(words[:k]), " ".join(words[k:])


def _grams(w: np.ndarray) -> np.ndarray:
    """Hashes of 3-word shingles; of the words themselves if there are fewer."""
    if len(w) < 3:
        return np.unique(w)
    with np.errstate(over="ignore"):
        return np.unique(mix((w[:-2] * U64(0xBF58476D1CE4E5B9) + w[1:-1]) * U64(0xBF58476D1CE4E5B9) + w[2:]))


class Index:
    """BM25 postings of items that are looked for in windows of ``width`` words, in order of item, with the largest impact of each block of a list; memory follows the number of postings."""

    def __init__(self, items: list[tuple[object, str]], df: dict[int, int], n_items: int, mean_words: float, width: int = 64) -> None:
        split = [(i, text_words(t), *map(text_words, parts(t))) for i, t in items if t]
        split = [x for x in split if len(x[1])]
        split.sort(key=lambda x: len(x[1]))  # blocks of alike items have tight bounds
        self.ids = [x[0] for x in split]
        self.words = [x[1] if len(x[1]) < SHORT_WORDS else None for x in split]
        self.question = [_grams(x[2]) for x in split]
        self.answer = [_grams(x[3]) for x in split]
        self.width = width
        self.n_blocks = -(-len(split) // BLOCK_ITEMS)
        hashed, which, impact = [], [], []
        for k, (_, w, _, _) in enumerate(split):
            terms, tf = np.unique(w, return_counts=True)
            d = np.array([df[t] for t in terms.tolist()], dtype=np.float64)
            weight = np.log(1 + (n_items - d + 0.5) / (d + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean_words))
            hashed.append(terms)
            which.append(np.full(len(terms), k, dtype=np.int32))
            impact.append(np.rint(weight / weight.sum() * 2**40) / 2**40)  # sums are exact, in any order of the terms
        hashed = np.concatenate(hashed) if hashed else np.zeros(0, U64)
        by = np.argsort(hashed, kind="stable")
        self.terms, first = np.unique(hashed[by], return_index=True)
        self.item = np.concatenate(which)[by] if which else np.zeros(0, np.int32)
        self.impact = np.concatenate(impact)[by] if impact else np.zeros(0)
        n = len(self.item)
        term = np.repeat(np.arange(len(self.terms)), np.diff(np.append(first, n)))
        change = np.ones(n, dtype=bool)
        change[1:] = (term[1:] != term[:-1]) | (self.item[1:] // BLOCK_ITEMS != self.item[:-1] // BLOCK_ITEMS)
        self.start = np.append(np.flatnonzero(change), n)  # where each block of a list begins among the postings
        self.block = self.item[self.start[:-1]] // BLOCK_ITEMS
        self.most = np.maximum.reduceat(self.impact, self.start[:-1]) if n else np.zeros(0)
        self.lists = np.searchsorted(term[self.start[:-1]], np.arange(len(self.terms) + 1))  # where each list begins among the blocks
        self.slots = np.zeros(1 << 20, dtype=bool)
        self.slots[self.terms >> U64(44)] = True

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """The place of each word among the terms, or their number."""
        out = np.full(len(words), len(self.terms), dtype=np.int32)
        maybe = np.flatnonzero(self.slots[words >> U64(44)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.terms, words[maybe]), len(self.terms) - 1)
            hit = self.terms[at] == words[maybe]
            out[maybe[hit]] = at[hit]
        return out

    def live(self, terms: np.ndarray, begin: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
        """(window, its blocks whose bound reaches the threshold); window w has the terms from ``begin[w]`` to ``begin[w + 1]``."""
        many = max(1, min(512, 4_000_000 // max(self.n_blocks, 1)))
        for lo in range(0, len(begin) - 1, many):
            cut = begin[lo : lo + many + 1]
            held = terms[cut[0] : cut[-1]]
            window = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
            n = self.lists[held + 1] - self.lists[held]
            to = np.cumsum(n)
            at = np.arange(int(to[-1])) + np.repeat(self.lists[held] - (to - n), n)
            bound = np.bincount(np.repeat(window, n) * self.n_blocks + self.block[at], weights=self.most[at], minlength=(len(cut) - 1) * self.n_blocks)
            hit = np.flatnonzero(bound >= threshold - 1e-9)
            if not len(hit):
                continue
            w, k = hit // self.n_blocks, hit % self.n_blocks
            some, first = np.unique(w, return_index=True)
            for x, part in zip(some.tolist(), np.split(k, first[1:]), strict=True):
                yield lo + x, part

    def wand(self, terms: np.ndarray, live: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items whose score for distinct ``terms`` reaches the threshold: the lists' cursors skip to the next of the ``live`` blocks, and move by WAND within it."""
        cursor, end = self.lists[terms].tolist(), self.lists[terms + 1].tolist()
        found = []
        for block in live.tolist():
            lists = []
            for t in range(len(cursor)):
                at = cursor[t]
                if at < end[t] and self.block[at] < block:
                    at = cursor[t] = at + int(np.searchsorted(self.block[at : end[t]], block))
                if at < end[t] and self.block[at] == block:
                    a, z = self.start[at], self.start[at + 1]
                    lists.append([self.item[a:z].tolist(), self.impact[a:z].tolist(), 0, float(self.most[at]) * (1 + 1e-9)])
            while lists:
                lists.sort(key=lambda c: c[0][c[2]])
                bound, pivot = 0.0, None
                for c in lists:
                    bound += c[3]
                    if bound >= threshold:
                        pivot = c[0][c[2]]
                        break
                if pivot is None:
                    break
                if lists[0][0][lists[0][2]] == pivot:
                    score = 0.0
                    for c in lists:
                        if c[0][c[2]] != pivot:
                            break
                        score += c[1][c[2]]
                        c[2] += 1
                    if score >= threshold:
                        found.append((pivot, score))
                else:
                    for c in lists:
                        while c[2] < len(c[0]) and c[0][c[2]] < pivot:
                            c[2] += 1
                lists = [c for c in lists if c[2] < len(c[0])]
        return found

    def verified(self, item: int, passage: np.ndarray) -> tuple[float, float]:
        """The shares of the item's question and answer in a passage; of a short item, 1 if all its words stand there in a row, else 0."""
        short = self.words[item]
        if short is not None:
            at = np.flatnonzero(passage[: max(len(passage) - len(short) + 1, 0)] == short[0])
            there = any(np.array_equal(passage[k : k + len(short)], short) for k in at.tolist())
            return (1.0, 1.0) if there else (0.0, 0.0)
        grams, single = _grams(passage), np.unique(passage)
        parts = (self.question[item], self.answer[item])
        return tuple(float(np.isin(g, grams if len(g) >= 3 else single, assume_unique=True).mean()) if len(g) else 0.0 for g in parts)

    def search(self, words: np.ndarray, first: np.ndarray, threshold: float, overlap: float) -> Iterator[tuple[int, int, float, float, float, int]]:
        """(row, item, score, question share, answer share, first word) of verified passages of rows of words."""
        if not len(self.ids) or not len(words):
            return
        width = self.width
        step = width // 2
        place = self.lookup(words)
        starts = [np.arange(a, max(b - step, a + 1), step) if b > a else np.zeros(0, np.int64) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        begin, row = np.concatenate(starts), np.repeat(np.arange(len(starts)), [len(x) for x in starts])
        end = np.minimum(begin + width, first[row + 1])
        term = np.flatnonzero(place < len(self.terms))
        if not len(begin) or not len(term):
            return
        # The distinct terms of each window.
        a, b = np.searchsorted(term, begin), np.searchsorted(term, end)
        many = b - a
        at = np.repeat(a - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        base = len(self.terms) + 1
        pairs = np.unique(np.repeat(np.arange(len(begin)), many) * base + place[term[at]])
        window, held = pairs // base, pairs % base
        some, start = np.unique(window, return_index=True)
        start = np.append(start, len(pairs))
        for i, blocks in self.live(held, start, threshold):
            w = int(some[i])
            passage = words[begin[w] : end[w]]
            for item, score in self.wand(held[start[i] : start[i + 1]], blocks, threshold):
                share = self.verified(item, passage)
                if min(share) >= overlap:
                    yield int(row[w]), item, score, *share, int(begin[w] - first[row[w]])


def width_of(words: int) -> int:
    """Words of the windows in which an item of so many words is looked for."""
    return max(64, 1 << (2 * words - 1).bit_length())


class Shard:
    """The items of a shard, an index for each width of windows."""

    def __init__(self, items: list[tuple[object, str]], df: dict[int, int], n_items: int, mean_words: float) -> None:
        by: dict[int, list[tuple[object, str]]] = {}
        for i, t in items:
            if n := len(text_words(t or "")):
                by.setdefault(width_of(n), []).append((i, t))
        self.indexes = [Index(some, df, n_items, mean_words, width) for width, some in sorted(by.items())]
        self.ids = [i for x in self.indexes for i in x.ids]

    def search(self, words: np.ndarray, first: np.ndarray, threshold: float, overlap: float) -> Iterator[tuple[int, int, float, float, float, int]]:
        before = 0
        for x in self.indexes:
            for row, item, *rest in x.search(words, first, threshold, overlap):
                yield row, before + item, *rest
            before += len(x.ids)


def _found(index, threshold: float, overlap: float, batch: pa.RecordBatch, text_at: int) -> list[tuple[int, int, float, float, float, int]]:
    """(row of the batch, item, ...): the best passage of each row and item."""
    best: dict[tuple[int, int], tuple] = {}
    with np.errstate(over="ignore"):
        for lo, _, buf, offs in blocks(_lowered(batch.column(text_at)), lower=False):
            starts, ends, first = spans(buf, offs, PUNCTUATION)
            for row, item, *rest in index.search(hashes(buf, starts, ends), first, threshold, overlap):
                key = (lo + row, item)
                if key not in best or best[key] < tuple(rest):
                    best[key] = tuple(rest)
    return [(*k, *v) for k, v in sorted(best.items())]


def _matcher(index, threshold: float, overlap: float, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _found(index.value, threshold, overlap, b, 1)
            ids = index.value.ids
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([x[0] for x in found], pa.int64())), pa.array([ids[x[1]] for x in found], item_type), *[pa.array([x[k] for x in found], pa.float64()) for k in (2, 3, 4)], pa.array([x[5] for x in found], pa.int64())],
                names=["id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"],
            )

    return run


def _dropper(index, threshold: float, overlap: float, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, dtype=bool)
            keep[[x[0] for x in _found(index.value, threshold, overlap, b, text_at)]] = False
            yield b.filter(pa.array(keep))

    return run


def indexes(items: DataFrame, *, item_id: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES) -> Iterator[Shard]:
    """The index in shards of about ``shard_bytes`` of item text."""
    named, (item, text), _ = numbered(items, (), item_id, item_text)
    rows = named.select(F.col(item).alias("i"), F.col(text).cast("string").alias("t")).filter("t is not null and t <> ''")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [text_words(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, found)), pa.int32()), pa.array([np.unique(x).view(np.int64).tolist() for x in found], pa.list_(pa.int64()))], names=["s", "n", "w"])

    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    shard = F.pmod(F.xxhash64("t"), F.lit(shards))
    split = rows.select(shard.alias("s"), "t").mapInArrow(words, "s long, n int, w array<long>")
    n_items, mean = split.filter("n > 0").agg(F.count("*"), F.avg("n")).first()
    counts = split.select("s", F.explode("w").alias("w"))
    total = counts.groupBy("w").agg(F.count("*").alias("df"))
    for s in range(shards):
        mine = rows.filter(shard == s).collect()
        df = total.join(counts.filter(F.col("s") == s).select("w").distinct(), "w").collect()
        known = {int(np.int64(r["w"]).view(U64)): r["df"] for r in df}
        yield Shard(sorted(((r["i"], r["t"]) for r in mine), key=lambda x: (x[0] is None, 0 if x[0] is None else x[0], x[1])), known, n_items, mean or 1.0)


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", threshold: float = THRESHOLD, overlap: float = OVERLAP, **index) -> DataFrame:
    """A row for each document and item whose text it holds: id, item_id, score, question_overlap, answer_overlap, first_word."""
    named, (doc, text), _ = numbered(docs, (), id_col, text_col)
    rows = named.select(F.col(doc).alias("id"), F.col(text).cast("string").alias("text"))
    kind = items.schema[place(items, item_id)].dataType
    schema = f"id {named.schema[doc].dataType.simpleString()}, item_id {kind.simpleString()}, score double, question_overlap double, answer_overlap double, first_word long"
    out = None
    for shard in indexes(items, item_id=item_id, **index):
        part = rows.mapInArrow(_matcher(docs.sparkSession.sparkContext.broadcast(shard), threshold, overlap, to_arrow_type(kind)), schema)
        out = part if out is None else out.unionAll(part)
    return out.withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, **index) -> DataFrame:
    """``docs`` without the rows that hold an item; no join, rows are dropped where they are searched."""
    rows, (text,), names = numbered(docs, (), text_col)
    out = rows.withColumn(text, F.col(text).cast("string"))
    kinds = out.schema
    for shard in indexes(items, **index):
        out = out.mapInArrow(_dropper(docs.sparkSession.sparkContext.broadcast(shard), threshold, overlap, rows.columns.index(text)), kinds)
    return out.toDF(*names.values())
