"""Byte-level BPE over a corpus: every distinct pre-token is encoded once, by a global shuffle of distinct words.

A task splits its texts into pre-tokens and numbers the distinct ones of a run of texts (a chunk), so a text is the list
of its words' numbers, in order of position.  One exchange moves both kinds of rows: the distinct words of a chunk, packed by bucket of their
hash, to the task of the bucket, and the packed positions to the task of the chunk.  A bucket's task encodes each of its words
once, whatever the number of chunks that hold it, and answers each chunk with the ids in the order of the words; the chunk's task joins them
by bucket and number, and reassembles every text by position.  Decoding joins the ids with the table of token bytes.

A word that a third of all texts hold is one entry a chunk.  A bucket holds one entry for each chunk and distinct word; the number of
buckets follows the shuffle partitions.  Chunks hold ``chunk_chars`` characters or one longer text.

Defined cases: null and empty texts have no tokens; a text of any length is one row of one chunk, and a run of any length one pre-token; ids may be of any type;
repeated rows and null ids are rows as any other (ties don't arise); an empty table gives an empty result; columns beside id and text aren't read, whatever their names.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.text import numbered

CHUNK_CHARS = 8_000_000
#: From so many characters on a text is split piece by piece; the ids are the same.
LONG_TEXT = 100_000
_PACKED = "part long, chunk long, bucket int, words binary, rows binary, counts binary"


class Vocabulary:
    """Ranks of a rank file (base64 token, rank a line) and the pattern of pre-tokens."""

    def __init__(self, data: bytes, pattern: str) -> None:
        self.data, self.pattern = data, pattern
        self._made: dict = {}

    def __getstate__(self):
        return self.data, self.pattern

    def __setstate__(self, state) -> None:
        self.data, self.pattern = state
        self._made = {}

    def _once(self, name: str, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def ranks(self) -> dict[bytes, int]:
        return self._once("ranks", lambda: {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.data.splitlines()) if a})

    @property
    def regex(self):
        import regex

        return self._once("regex", lambda: regex.compile(self.pattern))

    @property
    def library(self):
        import tiktoken

        return self._once("library", lambda: tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={}))

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token; the pattern isn't run again, so a piece may be of any length."""
        return self.library._encode_single_piece(piece) if piece else []

    def count(self, text: str) -> int:
        """How many tokens a text has.  The library's own pattern takes stack for every character of a run, so long texts are split here."""
        if len(text) < LONG_TEXT:
            return len(self.library.encode_ordinary(text))
        return sum(len(self.encode(w.encode("utf-8", "surrogatepass"))) for part in _pieces(self, text) for w in part)

    @property
    def table(self) -> pa.Array:
        """Token bytes by id."""

        def make() -> pa.Array:
            out = [b""] * (max(self.ranks.values()) + 1)
            for token, rank in self.ranks.items():
                out[rank] = token
            return pa.array(out, pa.large_binary())

        return self._once("table", make)

    @property
    def decimals(self) -> pa.Array:
        return self._once("decimals", lambda: pa.array([b"%d," % i for i in range(len(self.table))], pa.large_binary()))


def vocabulary(path: str, pattern: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary(f.read(), pattern)


def _zip(*arrays: np.ndarray | bytes) -> bytes:
    parts = [x if isinstance(x, bytes) else x.tobytes() for x in arrays]
    head = np.array([len(parts), *map(len, parts)], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def _unzip(data: bytes) -> list[memoryview]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(data))
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    sizes = np.frombuffer(raw[8 : 8 + 8 * n], np.int64).tolist()
    out, at = [], 8 + 8 * n
    for s in sizes:
        out.append(raw[at : at + s])
        at += s
    return out


def _pieces(vocab: Vocabulary, text: str) -> Iterator[list[str]]:
    if len(text) < 4_000_000:
        yield vocab.regex.findall(text)
        return
    found = (m[0] for m in vocab.regex.finditer(text))
    while part := list(islice(found, 200_000)):
        yield part


def _split(vocab, buckets: int, chunk_chars: int):
    """id, text -> for each chunk a row a bucket with its words and one row with ids and word numbers."""

    def chunk_rows(chunk: int, ids: list[pa.Array], counts: list[int], seq: list[np.ndarray], number: dict[str, int]) -> pa.RecordBatch:
        by: list[list[tuple[bytes, int]]] = [[] for _ in range(buckets)]
        for w, i in number.items():
            b = w.encode("utf-8", "surrogatepass")
            by[zlib.crc32(b) % buckets].append((b, i))
        place = np.zeros(len(number), dtype=np.uint32)
        parts, which, blobs, at = [], [], [], 0
        for k, held in enumerate(by):
            if not held:
                continue
            held.sort()
            place[[i for _, i in held]] = np.arange(at, at + len(held), dtype=np.uint32)
            at += len(held)
            which.append(k)
            parts.append(-1 - k)
            blobs.append(_zip(np.array([len(b) for b, _ in held], dtype=np.uint32), b"".join(b for b, _ in held)))
        order = place[np.concatenate(seq)] if seq else place[:0]
        id_rows = pa.record_batch([pa.concat_arrays(ids)], names=["id"]).serialize().to_pybytes()
        n = len(parts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*parts, chunk], pa.int64()), pa.array([chunk] * (n + 1), pa.int64()), pa.array([*which, None], pa.int32()),
                pa.array([*blobs, None], pa.binary()), pa.array([None] * n + [id_rows], pa.binary()), pa.array([None] * n + [_zip(np.array(counts, np.int64), order)], pa.binary()),
            ],
            names=["part", "chunk", "bucket", "words", "rows", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        base, made = TaskContext.get().partitionId() << 32, 0
        ids, counts, seq, number, chars = [], [], [], {}, 0
        for b in batches:
            lo = 0
            for i, text in enumerate(b.column(1)):
                n, text = 0, text.as_py() or ""
                for words in _pieces(v, text):
                    seq.append(np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words)))
                    n += len(words)
                counts.append(n)
                chars += len(text)
                if chars >= chunk_chars:
                    ids.append(b.column(0).slice(lo, i + 1 - lo))
                    yield chunk_rows(base + made, ids, counts, seq, number)
                    ids, counts, seq, number, chars, lo, made = [], [], [], {}, 0, i + 1, made + 1
            if lo < b.num_rows:
                ids.append(b.column(0).slice(lo))
        if ids:
            yield chunk_rows(base + made, ids, counts, seq, number)

    return run


def _encode(vocab):
    """Rows of words, sorted by bucket -> part (the chunk), bucket, ids: counts and ids of the words, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocab.value.encode
        known: dict[bytes, list[int]] = {}
        now = None
        for b in batches:
            chunks, which, blobs = [], [], []
            for chunk, bucket, words in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if bucket is None:
                    continue
                if bucket != now:
                    known, now = {}, bucket
                lens, data = _unzip(words.as_py())
                ends = np.cumsum(np.frombuffer(lens, np.uint32), dtype=np.int64).tolist()
                found, lo = [], 0
                for hi in ends:
                    w = bytes(data[lo:hi])
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = encode(w)
                    found.append(ids)
                    lo = hi
                chunks.append(chunk)
                which.append(bucket)
                blobs.append(_zip(np.array(list(map(len, found)), np.uint32), np.array([i for ids in found for i in ids], np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(which, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "bucket", "ids"])

    return run


def _join(vocab, id_type: pa.DataType):
    """One chunk's texts and its buckets' ids -> id, n_tokens, ids_text, decoded."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        v = vocab.value
        made = []
        names = ["id", "n_tokens", "ids_text", "decoded"]
        kinds = [id_type, pa.int64(), pa.string(), pa.binary()]
        for chunk, bucket, rows, counts in zip(*(texts.column(c).to_pylist() for c in ("chunk", "bucket", "rows", "counts")), strict=True):
            if bucket is not None:
                continue
            ids = pa.ipc.read_record_batch(pa.py_buffer(rows), pa.schema([("id", id_type)])).column(0)
            got = sorted(zip(answers.column("bucket").to_pylist(), answers.column("ids").to_pylist(), strict=True))
            parts = [_unzip(x) for _, x in got]
            n = np.concatenate([np.frombuffer(p[0], np.uint32) for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
            all_ids = np.concatenate([np.frombuffer(p[1], np.uint32) for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
            at = np.cumsum(n) - n
            per, order = _unzip(counts)
            per, order = np.frombuffer(per, np.int64), np.frombuffer(order, np.uint32)
            ends = np.cumsum(per)
            tokens, decimal, plain = [], [], []
            row = 0
            while row < len(per):
                to = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + 200_000, side="right")))
                w = order[(ends[row - 1] if row else 0) : ends[to - 1]]
                many = n[w]
                first = np.cumsum(many) - many
                flat = all_ids[np.arange(int(many.sum())) + np.repeat(at[w] - first, many)]
                cut = np.append(first, len(flat))[np.concatenate(([0], ends[row:to] - (ends[row - 1] if row else 0)))]
                take = pa.array(flat)
                for table, out, short in ((v.decimals, decimal, 1), (v.table, plain, 0)):
                    joined = table.take(take)
                    offs = np.frombuffer(joined.buffers()[1], np.int64, count=len(flat) + 1)[cut].tolist() if len(flat) else [0] * len(cut)
                    data = memoryview(joined.buffers()[2]) if len(flat) else memoryview(b"")
                    out += [bytes(data[x : max(x, y - short)]) for x, y in zip(offs[:-1], offs[1:], strict=True)]
                tokens += np.diff(cut).tolist()
                row = to
            made.append(pa.table([ids, pa.array(tokens, pa.int64()), pa.array(decimal, pa.binary()).cast(pa.string()), pa.array(plain, pa.binary())], names=names))
        return pa.concat_tables(made) if made else pa.table([pa.array([], k) for k in kinds], names=names)

    return run


def encode_decode(docs: DataFrame, vocab: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """For each row the id, ``n_tokens``, ``ids_text`` (decimal ids joined by commas) and ``decoded`` (bytes decoded from the ids)."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocab)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named, (doc, text), _ = numbered(docs, (), id_col, text_col)
    id_type = named.schema[doc].dataType
    rows = named.select(F.col(doc).alias("id"), F.col(text).cast("string").alias("text"))
    packed = rows.mapInArrow(_split(shared, 4 * parts, chunk_chars), _PACKED).repartition(parts, "part").sortWithinPartitions("part")
    answers = packed.mapInArrow(_encode(shared), "part long, bucket int, ids binary").repartition(parts, "part")
    schema = f"id {id_type.simpleString()}, n_tokens long, ids_text string, decoded binary"
    joined = packed.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_join(shared, to_arrow_type(id_type)), schema)
    return joined.withColumnRenamed("id", id_col)


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
