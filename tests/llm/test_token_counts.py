import public_tokenizers
import pytest

from trialweave.llm import bpe, token_counts as tc


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), tc.CHANGES)


def test_commits(spark, tmp_path):
    r = tc.Rollup(spark, f"file://{tmp_path}/r")
    assert r.totals().count() == 0
    a = changes(spark, ("insert", "s", "en", "v1", 10, None), ("insert", "s", "en", "v1", 5, None), ("insert", None, None, "v1", None, None))
    assert r.commit("a", a)
    assert not r.commit("a", a)
    assert r.commit("b/ü", changes(spark, ("revise", "s", "en", "v1", 7, 10), ("delete", "s", "en", "v1", 5, None)))
    want = [("s", "en", "v1", 1, 7), (None, None, "v1", 1, 0)]
    assert sorted(map(tuple, r.totals().collect()), key=str) == sorted(want, key=str)
    r.compact()
    r.compact()
    assert not r.commit("a", a) and not r.commit("b/ü", a)
    assert sorted(map(tuple, r.totals().collect()), key=str) == sorted(want, key=str)
    assert r.commit("c", changes(spark, ("delete", "s", "en", "v1", 7, None)))
    assert list(map(tuple, r.totals().collect())) == [(None, None, "v1", 1, 0)]
    assert r.commit("none", a.limit(0))
    with pytest.raises(Exception, match="unknown op"):
        r.commit("odd", changes(spark, ("move", "s", "en", "v1", 7, None)))
    assert r.commit("odd", changes(spark, ("insert", "s", "en", "v1", 7, None)))


def test_replay_equals_plain_counting(spark, sf):
    vocab = {v: bpe.vocabulary(public_tokenizers.path(f"{v}.tiktoken"), public_tokenizers.PATTERN) for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "text")
    docs = docs.unionByName(spark.createDataFrame([(10**9, None, "en", None), (10**9 + 1, "x", None, ""), (10**9 + 2, "x", None, "")], docs.schema))
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    want, seen = {}, set()
    for r in rows:
        if r["text"] in seen:
            continue
        seen.add(r["text"])
        for v, x in vocab.items():
            n = want.setdefault((r["source"], r["lang"], v), [0, 0])
            n[0] += 1
            n[1] += len(x.library.encode_ordinary(r["text"] or ""))
    got = {(r[0], r[1], r[2]): [r[3], r[4]] for r in tc.replayed(docs, vocab).collect()}
    assert got == want


def test_query_counts_every_row(spark, sf):
    from trialweave.llm import queries

    vocab = {v: bpe.vocabulary(public_tokenizers.path(f"{v}.tiktoken"), public_tokenizers.PATTERN) for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len({r["text"] for r in rows}) < len(rows)
    want = {}
    for r in rows:
        for v, x in vocab.items():
            n = want.setdefault((r["source"], r["lang"], v), [0, 0])
            n[0] += 1
            n[1] += len(x.library.encode_ordinary(r["text"] or ""))
    got = {(r[0], r[1], r[2]): [r[3], r[4]] for r in queries.op4_token_counts(spark, sf).collect()}
    assert got == want


def test_a_commit_during_compaction_stays(spark, tmp_path):
    r = tc.Rollup(spark, f"file://{tmp_path}/r")
    insert = lambda n: changes(spark, ("insert", "s", "en", "v1", n, None))
    r.commit("a", insert(10))
    listed = r._sum

    def meanwhile(live):
        r.commit("b", insert(5))
        return listed(live)

    r._sum = meanwhile
    r.compact()
    r._sum = listed
    assert [x["n_tokens"] for x in r.totals().collect()] == [15]
    assert not r.commit("b", insert(5)) and not r.commit("a", insert(10))
    r.compact()
    assert [x["n_tokens"] for x in r.totals().collect()] == [15] and not r.commit("b", insert(5))


def test_long_runs_clashing_names_and_no_rows(spark):
    vocab = {v: bpe.vocabulary(public_tokenizers.path(f"{v}.tiktoken"), public_tokenizers.PATTERN) for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    rows = [(1, " " * 2_000_000 + "x", 1), (2, "a" * 2_000_000, 2), (3, None, 3), (3, "#" * 150_000, 3)]
    docs = spark.createDataFrame(rows, "t long, text string, Byte_BPE_50k long")
    got = tc.counted(docs, vocab)
    assert got.columns == ["t", *vocab]
    for r, (_, text, _) in zip(sorted(got.collect(), key=lambda r: (r["t"], r["byte_bpe_50k"])), rows, strict=True):
        for name, v in vocab.items():
            want = len(v.library.encode_ordinary(text or "")) if len(text or "") < 200_000 else sum(len(v.encode(w.encode())) for p in bpe._pieces(v, text) for w in p)
            assert r[name] == want
    none = spark.createDataFrame([], "doc_id long, source string, lang string, text string")
    assert tc.replayed(none, vocab).count() == 0
