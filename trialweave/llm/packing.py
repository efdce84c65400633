"""Documents packed into as few token sequences as can be, with lower bounds that say when a packing can't be better.

A task encodes its texts and packs the pieces best-fit decreasing where they are read.  Dual feasible functions of the lengths give a lower bound on the number of sequences
that these pieces need.  Where the packing meets it, only the emptiest sequence is handed on; where a gap is left, every sequence with free space is.  What is handed on
is exchanged: dealt anew to fewer tasks, packed best-fit decreasing and certified again, until one task holds the rest or an exchange has closed less than a tenth of it.  An exchange keeps the
former sequences where best-fit decreasing wouldn't save one, so the number never grows.

A text is encoded by the chunks between its spaces: a pre-token never reaches over a space that follows another character than white space, so the ids of a text are those of its chunks,
and each chunk is encoded once as long as a task remembers it.  The tokenizer is given as its JSON, whose library encodes what stands beyond Latin letters and what holds a special token;
the same vocabulary as ranks encodes the rest, faster.

Defined cases: null and empty texts are a document of the closing id alone; longer documents than a sequence are cut from their end, so their first piece is the one that may be
shorter; pieces of equal length (ties) are placed in the order they are read in; repeated rows and null ids are documents as any other; an empty table gives an empty result;
columns beside id and text aren't read, whatever their names.  The string of a special token within a text becomes that token, as the library does by default.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.bpe import LONG_TEXT, Vocabulary, _pieces
from trialweave.llm.text import numbered, whole
from trialweave.plans.staging import staged

CAPACITY = 2048
#: So many pieces are packed together; they are held by one task.
TOGETHER = 100_000
#: A task remembers so many chunks.
REMEMBERED = 400_000
#: Code points from here on go to the library itself.
BEYOND = "ɐ"
_AFTER_SPACE = re.compile(r"\s ")
_CHUNK = re.compile(r"(?<=\S)(?= )")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, json: str, ranks: Vocabulary) -> None:
        self.json, self.ranks = json, ranks

    def __getstate__(self):
        return self.json, self.ranks

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def __getattr__(self, name: str):
        if name == "library":
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.json)
            return self.library
        if name == "special":
            self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
            return self.special
        if name == "known":
            self.known = _Known(self)
            return self.known
        raise AttributeError(name)

    def part(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if not text:
            return b""
        if not text.isascii() and max(text) >= BEYOND:
            ids = self.library.encode(text, add_special_tokens=False).ids
        elif len(text) < LONG_TEXT:
            ids = self.ranks.library.encode_ordinary(text)
        else:
            ids = [i for words in _pieces(self.ranks, text) for w in words for i in self.ranks.encode(w.encode())]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _AFTER_SPACE.search(text):
            first, *rest = _CHUNK.split(text)
            rest = [c[1:] for c in rest]
        else:
            first, *rest = text.split(" ")
        return self.part(first) + b"".join(map(self.known.__getitem__, rest))


class _Known(dict):
    """Ids of a space and a chunk."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.encoder.part(" " + chunk)
        if len(chunk) < 64:
            self[chunk] = ids
        return ids


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and the place in it of each piece, and what each bin holds."""
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    held: list[int] = []
    rooms = 0  # bit r: there is a bin with r free places
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                rooms ^= 1 << r
        else:
            b, r = len(held), capacity
            held.append(0)
        bins[i], places[i] = b, capacity - r
        held[b] += n
        if r > n:
            free[r - n].append(b)
            rooms |= 1 << (r - n)
    return bins, places, np.array(held, np.int64)


def lower_bound(counts: np.ndarray) -> int:
    """Bins that ``counts[n]`` pieces of each length n need at least, by three families of dual feasible functions; the capacity is the last length."""
    capacity = len(counts) - 1
    n = np.arange(capacity + 1)
    c = counts.astype(object)  # sums of any size
    have = np.flatnonzero(counts)
    have = have[have > 0]
    if not len(have):
        return 0
    s, c = n[have], c[have]
    up = lambda total, parts: -(-total // parts)
    best = up(int((s * c).sum()), capacity)
    for k in range(1, min(capacity, 100)):
        x = (k + 1) * s
        exact = x % capacity == 0
        value = np.where(exact, k * s, (x // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, up(int((value * c).sum()), k * capacity))
    for e in range(1, capacity // 2 + 1):
        value = np.where(s > capacity - e, capacity, np.where(s >= e, s, 0))
        best = max(best, up(int((value * c).sum()), capacity))
        parts = capacity // e
        value = np.where(2 * s > capacity, parts - (capacity - s) // e, np.where(s >= e, 1, 0))
        best = max(best, up(int((value * c).sum()), parts))
    return best


def _handed_on(held: np.ndarray, bound: int, capacity: int) -> np.ndarray:
    """Which bins are handed on: of a packing that meets its bound the emptiest, else all with free space."""
    out = np.zeros(len(held), bool)
    if len(held) > bound:
        out = held < capacity
    elif len(held):
        k = int(np.argmin(held))
        out[k] = held[k] < capacity
    return out


def _bound(lengths: np.ndarray, capacity: int) -> int:
    return lower_bound(np.bincount(lengths, minlength=capacity + 1))


_COLUMNS = "piece int, start long, length int, ids_crc32 long, sequence_id long, offset int, open boolean"
_NAMES = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "open"]


def _first(encoder, capacity: int, together: int, closing: int, carry: bool):
    """id, text -> pieces in the sequences of their task."""

    end = np.array([closing], "<u4").tobytes()

    def packed(pid: int, made: int, ids: pa.Array, rows: list[tuple], blobs: list[bytes]) -> tuple[int, pa.RecordBatch]:
        doc, piece, start, length, crc = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        bins, places, held = best_fit(length, capacity)
        on = _handed_on(held, _bound(length, capacity), capacity)
        columns = [
            ids.take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc),
            pa.array((pid << 32) + made + bins), pa.array(places.astype(np.int32)), pa.array(on[bins]),
        ]
        return made + len(held), pa.RecordBatch.from_arrays([*columns, *([pa.array(blobs, pa.binary())] if carry else [])], names=[*_NAMES, *(["ids"] if carry else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pid, made = encoder.value.encode, TaskContext.get().partitionId(), 0
        held, rows, blobs, docs = [], [], [], 0
        for b in batches:
            lo = 0
            for i, text in enumerate(b.column(1)):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                a = 0
                for piece, z in enumerate(range(n % capacity or min(n, capacity), n + 1, capacity)):
                    blob = ids[4 * a : 4 * z]
                    rows.append((docs, piece, a, z - a, zlib.crc32(blob)))
                    if carry:
                        blobs.append(blob)
                    a = z
                docs += 1
                if len(rows) >= together:
                    made, out = packed(pid, made, pa.concat_arrays([*held, b.column(0).slice(lo, i + 1 - lo)]), rows, blobs)
                    yield out
                    held, rows, blobs, docs, lo = [], [], [], 0, i + 1
            if lo < b.num_rows:
                held.append(b.column(0).slice(lo))
        if rows:
            yield packed(pid, made, pa.concat_arrays(held), rows, blobs)[1]

    return run


def _again(turn: int, last: bool, capacity: int):
    """Pieces of whole sequences, sorted by sequence and offset -> the same in fewer sequences, or as they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        rows = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.record_batch({})])
        if not rows.num_rows:
            return
        length, before = (rows.column(c).to_numpy().astype(np.int64) for c in ("length", "sequence_id"))
        former, came = np.unique(before, return_inverse=True)
        bins, places, held = best_fit(length, capacity)
        if len(held) < len(former):
            names, offset = (turn << 58) + (pid << 32) + np.arange(len(held)), places
        else:
            bins, names, offset = came, former, rows.column("offset").to_numpy().astype(np.int64)
            held = np.bincount(came, weights=length).astype(np.int64)
        on = np.zeros(len(held), bool) if last else _handed_on(held, _bound(length, capacity), capacity)
        for name, column in (("sequence_id", pa.array(names[bins])), ("offset", pa.array(offset.astype(np.int32))), ("open", pa.array(on[bins]))):
            rows = rows.set_column(rows.schema.get_field_index(name), name, column)
        yield from rows.to_batches(max_chunksize=50_000)

    return run


def pack(docs: DataFrame, encoder: Encoder, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, closing: int = 0, together: int = TOGETHER, carry: bool = True) -> DataFrame:
    """A row for each piece: the id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` and, with ``carry``, ``ids`` (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    named, (doc, text), _ = numbered(docs, (), id_col, text_col)
    schema = f"id {named.schema[doc].dataType.simpleString()}, {_COLUMNS}" + ", ids binary" * carry
    rows = named.select(F.col(doc).alias("id"), whole(F.col(text)).alias("text"))
    table = staged(rows.mapInArrow(_first(spark.sparkContext.broadcast(encoder), capacity, together, closing, carry), schema), "packed")
    done, before, turn = [table.filter("not open")], 1 << 62, 0
    while pieces := (rest := table.filter("open")).count():
        turn += 1
        parts = -(-pieces // together)
        last = parts == 1 or 10 * pieces > 9 * before or turn == 31
        before = pieces
        dealt = rest.repartition(parts, F.xxhash64(F.lit(turn), "sequence_id")).sortWithinPartitions("sequence_id", "offset")
        table = staged(dealt.mapInArrow(_again(turn, last, capacity), schema), "repacked")
        done.append(table.filter("not open"))
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out.drop("open").withColumnRenamed("id", id_col)


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: the number of sequences, and the lower bound of the whole table from its counts by length (as many rows as a sequence has places)."""
    spark = packed.sparkSession
    counts = np.zeros(capacity + 1, object)
    for r in packed.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    n = packed.select("sequence_id").distinct().count()
    return spark.createDataFrame([(n, lower_bound(counts))], "n_sequences long, lower_bound long")


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, of a packing that carries ``ids``; a sequence has a bounded number of places."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", "n_tokens", joined.alias("ids"))


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))
