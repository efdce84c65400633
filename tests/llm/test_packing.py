import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from trialweave.llm import bpe, packing


@pytest.fixture(scope="module")
def encoder():
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        return packing.Encoder(f.read(), bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def plain_ids(encoder, text):
    return np.array(encoder.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_equals_library(encoder):
    rng = random.Random(3)
    letters = [*"ab c  \n\t'sdtll.,!12é世　 \x1c\x85\xa0", "'re", "<|endoftext|>", "́", "٠"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 25)))
        assert encoder.encode(text) == plain_ids(encoder, text), repr(text)
    for text in ("x" * 300_000, " " * 300_000 + "a", "é" * 200_000, "word " * 50_000, ". " * 100_000):
        assert encoder.encode(text) == plain_ids(encoder, text)


def needed(lengths, capacity):
    """Fewest bins, by trying all ways."""
    best = [len(lengths)]
    order = sorted(lengths, reverse=True)

    def place(k, held):
        if len(held) >= best[0]:
            return
        if k == len(order):
            best[0] = len(held)
            return
        for i in range(len(held)):
            if held[i] + order[k] <= capacity and held[i] not in held[:i]:
                held[i] += order[k]
                place(k + 1, held)
                held[i] -= order[k]
        place(k + 1, [*held, order[k]])

    place(0, [])
    return best[0]


def test_bounds_and_best_fit():
    rng = np.random.default_rng(2)
    tight = 0
    for _ in range(150):
        capacity = int(rng.integers(5, 40))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 9)))
        bins, places, held = packing.best_fit(lengths, capacity)
        for b in range(len(held)):
            inside = sorted((int(p), int(n)) for p, n in zip(places[bins == b], lengths[bins == b], strict=True))
            assert [p for p, _ in inside] == [sum(n for _, n in inside[:k]) for k in range(len(inside))]
            assert sum(n for _, n in inside) == held[b] <= capacity
        bound, fewest = packing.lower_bound(np.bincount(lengths, minlength=capacity + 1)), needed(lengths.tolist(), capacity)
        assert bound <= fewest <= len(held)
        tight += bound == fewest
    assert tight > 120
    assert packing.lower_bound(np.bincount([6] * 10, minlength=11)) == 10  # more than half: each by itself, where the sum says 6
    assert packing.lower_bound(np.bincount([4] * 10, minlength=11)) == 5


def checked(encoder, docs, rows, capacity=2048):
    """Pieces are those of the documents, sequences are gapless; returns the number of sequences."""
    want = []
    for doc, text in docs:
        ids = plain_ids(encoder, text or "") + b"\0\0\0\0"
        n, a = len(ids) // 4, 0
        for piece, z in enumerate(range(n % capacity or capacity, n + 1, capacity)):
            want.append((doc, piece, a, z - a, zlib.crc32(ids[4 * a : 4 * z])))
            a = z
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in rows)
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in held.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))]
        assert sum(n for _, n in x) <= capacity
    return len(held)


def test_query(spark, sf, encoder):
    from trialweave.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_best_fit_packing"](spark, sf)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = got.collect()
    n = checked(encoder, docs, rows)
    assert n <= packing.lower_bound(np.bincount([r["length"] for r in rows], minlength=2049)) + 1


@pytest.mark.parametrize(("seed", "together", "capacity"), [(1, 100_000, 64), (2, 50, 64), (3, 60, 17), (4, 40, 300)])
def test_exchanges(spark, encoder, seed, together, capacity):
    rng = random.Random(seed)
    docs = [(k, " ".join(rng.choice(["a", "bb", "long word"]) for _ in range(rng.randrange(0, 2 * capacity if rng.random() < 0.2 else capacity)))) for k in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    packed = packing.pack(df, encoder, capacity=capacity, together=together).cache()
    n = checked(encoder, docs, packed.collect(), capacity)
    one = packing.best_fit(np.array([r["length"] for r in packed.collect()]), capacity)[2]
    cert = packing.certificate(packed, capacity).first()
    assert cert["n_sequences"] == n and cert["lower_bound"] <= n
    assert n <= len(one) + 2 + len(one) // 30  # nearly as few as one task with everything
    whole = packing.sequences(packed).collect()
    assert sorted(len(r["ids"]) // 4 for r in whole) == sorted(r["n_tokens"] for r in whole) and len(whole) == n


def test_odd_rows(spark, encoder):
    docs = [(None, "a b"), ("x", None), ("x", ""), ("y", "word " * 30_000), ("y", "word " * 30_000), ("z", "q" * 1_000_000), ("s", "a<|endoftext|>b")]
    df = spark.createDataFrame([(*d, "t", "u", 1) for d in docs], "doc_id string, text string, TEXT string, `a.b` string, piece int")
    checked(encoder, docs, packing.pack(df, encoder).collect())
    assert packing.pack(df.limit(0), encoder).count() == 0
    assert tuple(packing.certificate(packing.pack(df.limit(0), encoder)).first()) == (0, 0)
