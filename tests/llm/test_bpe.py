import base64
import hashlib

import public_tokenizers
import tiktoken

from trialweave.llm import bpe


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocab():
    return bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def check(spark, rows, **more):
    enc = library()
    got = bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string"), vocab(), **more).collect()
    want = []
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((d, len(ids), ",".join(map(str, ids)), (t or "").encode()))
    assert sorted(((r[0], r[1], r[2], bytes(r[3])) for r in got), key=str) == sorted(want, key=str)


def test_documents_equal_the_library(spark, sf):
    enc = library()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in bpe.digest(bpe.encode_decode(docs, vocab(), chunk_chars=50_000)).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for d, t in rows:
        ids = enc.encode_ordinary(t)
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_odd_rows(spark):
    check(spark, [(1, None), (2, ""), (2, ""), (None, "it's  the\n\n end\t \x1c x  y <|endoftext|>"), (4, "a" * 30_000 + " " * 5_000 + "🙂" * 999), (5, "the the the " * 4000), (6, "\x00\n")], chunk_chars=10_000)
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), vocab()).count() == 0


def test_runs_of_any_length(spark):
    """The library's own pattern overflows its stack on such runs; pieces and ids are those of its rule."""
    n = 2_000_000
    v = vocab()
    rows = [(1, " " * n + "x"), (2, "a" * n), (3, "#" * n), (4, "b c " * (n // 4))]
    got = {r["doc_id"]: r for r in bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string"), v).collect()}
    for d, t in rows:
        assert bytes(got[d]["decoded"]) == t.encode()
        want = [i for part in bpe._pieces(v, t) for w in part for i in v.encode(w.encode())]
        assert got[d]["n_tokens"] == len(want) and got[d]["ids_text"] == ",".join(map(str, want))
    # What one piece gives is what the library gives for it, as far as it goes.
    for t in (" " * 99_999 + "x", "a" * 99_999, "#" * 99_999):
        assert [i for part in bpe._pieces(v, t) for w in part for i in v.encode(w.encode())] == library().encode_ordinary(t)
