"""Removal of repeated 400-byte strings by column-wise construction of a collection's suffix order.

*Construction* (:func:`collection`).  Documents are inserted from their ends, one symbol of every document a round.  The new suffix of a
document stands in the order by its first symbol and then by the place of its previous suffix, so a round is one merge of the sorted new suffixes into the
Burrows-Wheeler transform, the common prefixes and the order, each read and rewritten in sequence (in memory up to ``SPOOL`` bytes, beyond it in a
scratch file of the task that is gone with it).  The common prefix with a neighbour is one more than the least common prefix between their previous suffixes.
Symbols are 8 bytes wide: a text enters as its eight phases, so 400 bytes are 50 symbols and a round less is needed for 8 bytes.

*Distribution.*  Whole texts of 1e5 bytes would take as many rounds over all bytes of the corpus, so texts are cut into segments that can be compared on
their own: each 400-byte window belongs to the smallest hash of its 192-byte strings; equal windows have the same one.  A run of windows with one hash is a segment (at most
400 windows).  Segments whose hash is found once can't hold a repeat and stay out (an exact count; a fixed bitmap of the others marks them in the second
scan).  Equal segments are one content with a multiplicity, counted before the shuffle; contents of a hash meet in one collection, built as above.  Every window is in one
segment, so nothing is compared with itself.  Runs of repeated windows go back to the occurrences and to the texts, which move once.

*Hot hashes.*  Contents of a hash with more than ``BLOCK_BYTES`` are dealt to blocks, a collection each; windows that stand in several blocks are
then found by the count of their 128-bit fingerprints, one of each repeated window and one of each other window of a block.

*Passages.*  The counted hashes are those that are smallest among the 192-byte strings of any 272 bytes (they hold the smallest of 400 too), so each string of 272 bytes, about
45 words, shares one with its copies.  ``shares_passage`` says that one of them stands in another row as well: true wherever 272 bytes are found in another text, false where no
192 are.  It changes nothing of what is removed.

Defined cases: null and empty texts have no bytes and nothing to remove; repeated rows repeat each other (for ``shares_passage`` equal ids with equal texts are one row); rows with null ids take part, ids
may be of any type; a text of any length is cut like the others, its segments spread over tasks; ties don't arise; an empty table gives an empty result; columns beside id and text aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trialweave.llm.bits import bitmap, slot, there
from trialweave.llm.text import numbered
from trialweave.llm.words import U64, _BYTE, blocks, mix
from trialweave.plans.staging import staged

LENGTH = 400
GRAM = 192
PASSAGE = 272
MOST = 400
WIDE = 8
BITS = 26
#: A column of more bytes than that goes to a scratch file.
SPOOL = 1 << 22
#: A collection takes whole hashes until it has so many bytes.
COLLECTION = 150_000
#: A hash with more bytes of different contents is dealt to blocks of about so many.
BLOCK_BYTES = 2_000_000


class Sequential:
    """A column of the collection that is only read through and rewritten."""

    def __init__(self, values: np.ndarray) -> None:
        self.file = None
        self.values = values

    def merge(self, where: np.ndarray, added: np.ndarray) -> np.ndarray:
        """``added`` enter at the true places of ``where``, what is there keeps its order."""
        n, kind = len(where), self.values.dtype
        file = None
        if n * kind.itemsize > SPOOL:
            file = tempfile.TemporaryFile()  # noqa: SIM115
            out = np.memmap(file, dtype=kind, mode="w+", shape=(n,))
        else:
            out = np.empty(n, dtype=kind)
        slab, old, new = 1 << 22, 0, 0
        for lo in range(0, n, slab):
            w = where[lo : lo + slab]
            k = int(np.count_nonzero(w))
            part = out[lo : lo + slab]
            part[w] = added[new : new + k]
            part[~w] = self.values[old : old + len(w) - k]
            new, old = new + k, old + len(w) - k
        self.values = out
        if self.file:
            self.file.close()
        self.file = file
        return out


def _least(lcp: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of lcp[lo..hi], both included, for each pair."""
    span = hi - lo + 1
    out = np.empty(len(lo), dtype=lcp.dtype)
    level, width, table = 0, 1, lcp
    power = np.maximum(span, 1)
    power = np.floor(np.log2(power)).astype(np.int64)
    for level in range(int(power.max()) + 1 if len(power) else 0):
        k = np.flatnonzero(power == level)
        out[k] = np.minimum(table[lo[k]], table[hi[k] - width + 1])
        table = np.minimum(table[:-width], table[width:]) if len(table) > width else table
        width *= 2
    return out


def collection(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, offset, common prefix with the one before) of all suffixes of symbol arrays in order; the empty ones stand first.

    Symbols are whole numbers; ends of documents differ from each other and from every symbol.
    """
    d = len(docs)
    lens = np.array([len(x) for x in docs], dtype=np.int64)
    flat = np.concatenate(docs) if d else np.zeros(0, np.int64)
    base = np.cumsum(lens) - lens
    _, flat = np.unique(flat, return_inverse=True)
    flat = flat.astype(np.int64) + 1
    key = Sequential(np.arange(d, dtype=np.int64))  # first symbol << 32 | place of the suffix without it; 0 for an end
    bwt = Sequential(np.where(lens > 0, flat[base + lens - 1] if len(flat) else 0, 0).astype(np.int32)[:d])
    lcp = Sequential(np.zeros(d, dtype=np.uint8))
    doc = Sequential(np.arange(d, dtype=np.int32))
    off = Sequential(lens.astype(np.int32))
    place = np.arange(d, dtype=np.int64)  # of the last suffix of each document
    for r in range(1, int(lens.max(initial=0)) + 1):
        on = np.flatnonzero(lens >= r)
        symbol = flat[base[on] + lens[on] - r]
        new = symbol << 32 | place[on]
        by = np.argsort(new)
        on, new, symbol = on[by], new[by], symbol[by]
        at = np.searchsorted(key.values, new)
        n = len(key.values)
        where = np.zeros(n + len(new), dtype=bool)
        mine = at + np.arange(len(new))
        where[mine] = True
        old = np.flatnonzero(~where)
        # Common prefixes with the neighbours, from those of the previous suffixes.
        prefix = lcp.values
        keys = key.merge(where, new)
        first = keys >> 32
        left = np.maximum(mine - 1, 0)
        same = (first[mine] == first[left]) & (mine > 0)
        k = np.flatnonzero(same)
        tail = keys & 0xFFFFFFFF
        fresh = np.zeros(len(new), dtype=np.uint8)
        fresh[k] = np.minimum(_least(prefix, tail[left[k]] + 1, tail[mine[k]]), 254) + 1
        prefixes = lcp.merge(where, fresh)
        right = mine + 1
        right = right[right < len(keys)]
        right = right[~where[right] & (first[right] == first[right - 1])]
        prefixes[right] = np.minimum(_least(prefix, tail[right - 1] + 1, tail[right]), 254) + 1
        keys[:] = np.where(first > 0, first << 32 | old[np.minimum(tail, n - 1)], keys)
        before = np.where(lens[on] > r, flat[np.maximum(base[on] + lens[on] - r - 1, 0)], 0)
        bwt.merge(where, before.astype(np.int32))
        doc.merge(where, on.astype(np.int32))
        off.merge(where, (lens[on] - r).astype(np.int32))
        place = old[place]
        place[on] = mine
    return doc.values, off.values, lcp.values


def repeated_windows(contents: list[bytes], times: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each content which of its windows stand elsewhere too; ``times``: how often it is there itself."""
    docs, owner, phase = [], [], []
    for i, c in enumerate(contents):
        windows = len(c) - length + 1
        for p in range(min(WIDE, windows)):
            last = (windows - 1 - p) // WIDE  # whole symbols up to the end of the phase's last window
            docs.append(np.frombuffer(c[p : p + last * WIDE + length], dtype=f">u{WIDE}").astype(np.uint64))
            owner.append(i)
            phase.append(p)
    out = [np.full(len(c) - length + 1, n > 1) for c, n in zip(contents, times, strict=True)]
    if not docs:
        return out
    doc, off, lcp = collection(docs)
    least = length // WIDE
    again = lcp >= least
    again[:-1] |= lcp[1:] >= least
    for x, t in zip(doc[again].tolist(), off[again].tolist(), strict=True):
        out[owner[x]][phase[x] + WIDE * t] = True
    return out


def _hashes(buf: np.ndarray, gram: int, base: int = 0xA0761D6478BD642F) -> np.ndarray:
    """Hashes of all strings of ``gram`` bytes, put together from strings of powers of two."""
    part, power, d = _BYTE[buf], U64(base), 1
    h, shift, done = None, U64(1), 0
    while True:
        if gram & d:
            h = part if h is None else h[: len(buf) - done - d + 1] + shift * part[done : len(buf) - d + 1]
            shift, done = shift * power, done + d
        if 2 * d > gram:
            return mix(h)
        part = part[:-d] + power * part[d:]
        power, d = power * power, d * 2


def _slide(x: np.ndarray, w: int, pick: np.ufunc, fill) -> np.ndarray:
    """The least (or largest) of each ``w`` values in a row."""
    n = len(x)
    grid = np.full(-(-n // w) * w, fill, dtype=x.dtype)
    grid[:n] = x
    grid = grid.reshape(-1, w)
    ahead = pick.accumulate(grid, axis=1).ravel()
    back = pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - w + 1], ahead[w - 1 : n])


def _anchors(h: np.ndarray, ends: np.ndarray, passage: int, gram: int) -> np.ndarray:
    """Places of all grams that are the least of a string of ``passage`` bytes; ``ends``: where the row of each byte ends."""
    w = passage - gram + 1
    if len(h) < w:
        return np.zeros(0, np.int64)
    least = _slide(h, w, np.minimum, ~U64(0))
    least[np.arange(len(least)) + passage > ends[: len(least)]] = 0
    around = np.concatenate((np.zeros(w - 1, U64), least, np.zeros(len(h) - len(least), U64)))
    return np.flatnonzero((_slide(around, w, np.maximum, U64(0)) == h) & (h > 0))


def _segments(h: np.ndarray, ends: np.ndarray, rows: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, start in the buffer, windows, hash) of all segments."""
    w = length - gram + 1
    if len(h) < w:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64))
    least = _slide(h, w, np.minimum, ~U64(0))
    start = np.flatnonzero(np.arange(len(least)) + length <= ends[: len(least)])
    row, least = rows[start], least[start]
    change = np.ones(len(start), dtype=bool)
    change[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(change)
    place = np.arange(len(start)) - np.repeat(at, np.diff(np.append(at, len(start))))
    at = np.flatnonzero(place % MOST == 0)
    return row[at], start[at], np.diff(np.append(at, len(start))), least[at]


def _laid_out(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the end of its row and its row."""
    n = np.diff(offs)
    return np.repeat(offs[1:], n), np.repeat(np.arange(len(n)), n)


def _keys(passage: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with np.errstate(over="ignore"):
                for _, _, buf, offs in blocks(b.column(0), lower=False):
                    if len(buf) < gram:
                        continue
                    h = _hashes(buf, gram)
                    key, n = np.unique(h[_anchors(h, _laid_out(offs)[0], passage, gram)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    return run


_FOUND = ["key", "c1", "c2", "id", "row", "start", "times", "hits", "size", "content", "anchor"]


def _found_schema(kind: str) -> str:
    return f"key long, c1 long, c2 long, id {kind}, row long, start long, times long, hits long, size long, content binary, anchor long"


def _found(length: int, gram: int, passage: int, id_type: pa.DataType, marked):
    """id, row, text -> occurrences (id, row, start of a content) and contents (times, content) of marked segments, and marked anchors (id, row, anchor)."""
    kinds = dict(zip(_FOUND, [*[pa.int64()] * 3, id_type, *[pa.int64()] * 5, pa.binary(), pa.int64()], strict=True))

    def rows_of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, kinds[c])) for c in _FOUND], names=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marked.value
        seen: dict[tuple[int, int], list] = {}

        def contents() -> pa.RecordBatch:
            rows = [(*c, *v) for c, v in seen.items()]
            col = lambda i: pa.array([x[i] for x in rows], pa.int64())
            return rows_of(len(rows), key=col(2), c1=col(0), c2=col(1), times=col(3), hits=col(4), size=pa.array([len(x[5]) for x in rows], pa.int64()), content=pa.array([x[5] for x in rows], pa.binary()))

        size = 0
        for b in batches:
            ids, rows = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                for lo, _, buf, offs in blocks(b.column(2), lower=False):
                    if len(buf) < gram:
                        continue
                    h = _hashes(buf, gram)
                    ends, row_of = _laid_out(offs)
                    spots = _anchors(h, ends, passage, gram)
                    value = h[spots]
                    keep = there(bits, (value & U64((1 << BITS) - 1)).astype(np.int64))
                    mine, anchor = row_of[spots[keep]] + lo, value[keep].view(np.int64)
                    first = np.ones(len(mine), dtype=bool)
                    first[1:] = (mine[1:] != mine[:-1]) | (anchor[1:] != anchor[:-1])
                    mine, anchor = mine[first], anchor[first]
                    if len(mine):
                        yield rows_of(len(mine), id=ids.take(pa.array(mine)), row=pa.array(rows[mine]), anchor=pa.array(anchor))
                    row, begin, many, key = _segments(h, ends, row_of, length, gram)
                    keep = there(bits, (key & U64((1 << BITS) - 1)).astype(np.int64))
                    row, begin, many, key = (x[keep] for x in (row, begin, many, key))
                    if not len(row):
                        continue
                    # How often the hash stands in the segment: all its places are among the anchors.
                    a, z = np.searchsorted(spots, begin), np.searchsorted(spots, begin + many + length - gram)
                    n = z - a
                    to = np.cumsum(n)
                    hits = np.add.reduceat(value[np.arange(int(to[-1])) + np.repeat(a - (to - n), n)] == np.repeat(key, n), to - n, dtype=np.int64)
                    raw = buf.tobytes()
                    cs = np.zeros((len(row), 2), dtype=np.int64)
                    for i, (s, m, k, n) in enumerate(zip(begin.tolist(), many.tolist(), key.view(np.int64).tolist(), hits.tolist(), strict=True)):
                        content = raw[s : s + m + length - 1]
                        c = tuple(np.frombuffer(hashlib.blake2b(content, digest_size=16).digest(), np.int64).tolist())
                        cs[i] = c
                        if c in seen:
                            seen[c][1] += 1
                        else:
                            seen[c] = [k, 1, n, content]
                            size += len(content)
                    yield rows_of(len(row), c1=pa.array(cs[:, 0].copy()), c2=pa.array(cs[:, 1].copy()), id=ids.take(pa.array(row + lo)), row=pa.array(rows[row + lo]), start=pa.array(begin - offs[row]))
                    if size > 40_000_000:
                        yield contents()
                        seen, size = {}, 0
        yield contents()

    return run


def _repeats(length: int):
    """Contents sorted by hash and block -> c1, c2, runs of repeated windows; for a hash in several blocks also its windows' fingerprints.

    A window's fingerprint comes with its content and place if the window stands once in the block, else without, once.
    """
    names = ["c1", "c2", "lo", "hi", "f1", "f2"]

    def solve(held: dict[tuple[int, int], list], spread: bool) -> Iterator[pa.RecordBatch]:
        alone: dict[int, int] = {}
        for key, *_ in held.values():
            alone[key] = alone.get(key, 0) + 1
        items = list(held.items())
        # A content that is alone with its hash needs no comparison but with itself.
        build = [i for i, (_, (key, times, hits, _)) in enumerate(items) if alone[key] > 1 or (times == 1 and hits > 1)]
        again = dict(zip(build, repeated_windows([items[i][1][3] for i in build], [items[i][1][1] for i in build], length), strict=True))
        c1, c2, lo, hi = [], [], [], []
        prints: list[np.ndarray] = []
        twice: list[np.ndarray] = []
        for i, (c, (_, times, _, content)) in enumerate(items):
            w = again[i] if i in again else np.full(len(content) - length + 1, times > 1)
            edge = np.flatnonzero(np.diff(np.concatenate(([False], w, [False]))))
            for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                c1.append(c[0])
                c2.append(c[1])
                lo.append(a)
                hi.append(z - 1 + length)
            if spread:
                buf = np.frombuffer(content, np.uint8)
                with np.errstate(over="ignore"):
                    f = np.stack([_hashes(buf, length, base).view(np.int64) for base in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)], axis=1)
                once = np.flatnonzero(~w)
                prints.append(np.column_stack([np.broadcast_to(np.array(c), (len(once), 2)), once, f[once]]))
                twice.append(f[w])
        yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in (c1, c2, lo, hi)], *[pa.nulls(len(c1), pa.int64())] * 2], names=names)
        if spread:
            p, t = np.concatenate(prints), np.unique(np.concatenate(twice), axis=0)
            col = lambda x: pa.array(np.ascontiguousarray(x))
            yield pa.RecordBatch.from_arrays([*[col(p[:, k]) for k in range(3)], pa.nulls(len(p), pa.int64()), col(p[:, 3]), col(p[:, 4])], names=names)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(t), pa.int64())] * 4, col(t[:, 0]), col(t[:, 1])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size, last = 0, None
        for b in batches:
            for key, salt, salts, c1, c2, times, hits, content in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                now = (key, salt, salts > 1)
                if now != last and held and (size > COLLECTION or now[2] or last[2]):
                    yield from solve(held, last[2])
                    held, size = {}, 0
                last = now
                if (c1, c2) in held:
                    held[c1, c2][1] += times
                else:
                    held[c1, c2] = [key, times, hits, content]
                    size += len(content)
        if held:
            yield from solve(held, last[2])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text, runs, shared -> id, n_bytes, n_removed, n_spans, kept, shares_passage."""
    for b in batches:
        out = []
        for text, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            data = (text or "").encode()
            merged: list[list[int]] = []
            for r in sorted((r["lo"], r["hi"]) for r in runs or ()):
                if merged and r[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], r[1])
                else:
                    merged.append(list(r))
            kept, at = [], 0
            for lo, hi in merged:
                kept.append(data[at:lo])
                at = hi
            kept.append(data[at:])
            rest = b"".join(kept)
            out.append((len(data), len(data) - len(rest), len(merged), rest))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *[pa.array([x[i] for x in out], pa.int64()) for i in range(3)], pa.array([x[3] for x in out], pa.binary()), b.column(3)],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept", "shares_passage"],
        )


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, passage: int = PASSAGE) -> DataFrame:
    """For each row the id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept``, the bytes that stay, and ``shares_passage``.

    ``length`` is a multiple of 8 and ``gram <= passage <= length``.
    """
    if length % WIDE or not 0 < gram <= passage <= length or gram == length:
        raise ValueError("length must be a multiple of 8, and gram <= passage <= length")
    spark = docs.sparkSession
    named, (doc, column), _ = numbered(docs, (), id_col, text_col)
    text = F.col(column).cast("string")
    kind = named.schema[doc].dataType
    rows = named.select(F.col(doc).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    long = rows.filter(F.octet_length("text") >= passage)
    keys = long.select("text").mapInArrow(_keys(passage, gram), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    marked = spark.sparkContext.broadcast(bitmap(keys.select(slot(F.col("key"), BITS).alias("h")), BITS))
    found = staged(long.mapInArrow(_found(length, gram, passage, to_arrow_type(kind), marked), _found_schema(kind.simpleString())), "segments")

    contents = found.filter("key is not null")
    # A hash with more bytes than a task should hold is dealt to blocks by content.
    hot = staged(contents.groupBy("key").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > BLOCK_BYTES).select("key", F.ceil(F.col("bytes") / BLOCK_BYTES).alias("blocks")), "hot")
    dealt = contents.join(hot, "key", "left").withColumn("salts", F.coalesce("blocks", F.lit(1)).cast("long")).withColumn("salt", F.pmod(F.col("c1"), F.col("salts")))
    ordered = dealt.select("key", "salt", "salts", "c1", "c2", "times", "hits", "content").repartition("key", "salt").sortWithinPartitions("key", "salt")
    solved = staged(ordered.mapInArrow(_repeats(length), "c1 long, c2 long, lo long, hi long, f1 long, f2 long"), "runs")
    prints = solved.filter("f1 is not null")
    across = prints.filter("c1 is not null").join(prints.groupBy("f1", "f2").count().filter("count > 1"), ["f1", "f2"], "left_semi")
    again = solved.filter("f1 is null").select("c1", "c2", "lo", "hi").unionAll(across.select("c1", "c2", "lo", (F.col("lo") + length).alias("hi")))

    places = found.filter("start is not null").select("c1", "c2", "id", "row", "start")
    runs = places.join(again, ["c1", "c2"]).select("id", "row", F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi")).alias("run"), F.lit(False).alias("shared"))
    anchors = found.filter("anchor is not null").select("anchor", "id", "row", F.xxhash64("id", "row").alias("doc"))
    common = anchors.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).filter("a <> z").select("anchor")
    sharing = anchors.join(common, "anchor", "left_semi").select("id", "row").distinct().select("id", "row", F.lit(None).cast("struct<lo: bigint, hi: bigint>").alias("run"), F.lit(True).alias("shared"))
    removed = runs.unionAll(sharing).groupBy(F.col("id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_set("run").alias("runs"), F.max("shared").alias("shared"))
    joined = rows.join(removed, F.col("id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row")), "left").select("id", "text", "runs", F.coalesce("shared", F.lit(False)).alias("shared"))
    out = joined.mapInArrow(_cut, f"id {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary, shares_passage boolean")
    return out.withColumnRenamed("id", id_col)


def digest(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "shares_passage")
