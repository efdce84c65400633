import zlib

import numpy as np

from trialweave.llm import factorisation as fm


def test_identity_equals_all_pairs():
    rng = np.random.default_rng(0)
    p = 3
    m = fm.Machine(0.3, rng.normal(size=fm.SLOTS + p).astype(np.float32), rng.normal(size=(fm.SLOTS + p, 4)).astype(np.float32), np.zeros(p), np.ones(p))
    slots = rng.integers(0, fm.SLOTS, 12).astype(np.int32)
    first = np.array([0, 5, 5, 12])
    x = rng.normal(size=(3, p))
    z = m._sums(slots, first, x)[0]
    for d in range(3):
        mine = slots[first[d] : first[d + 1]]
        index = [*mine.tolist(), *range(fm.SLOTS, fm.SLOTS + p)]
        value = [1 / np.sqrt(max(len(mine), 1))] * len(mine) + x[d].tolist()
        want = 0.3 + sum(m.linear[i] * v for i, v in zip(index, value, strict=True))
        want += sum(float(m.factors[index[a]] @ m.factors[index[b]]) * value[a] * value[b] for a in range(len(index)) for b in range(a))
        assert abs(z[d] - want) < 1e-3


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = fm.quality_scores(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    out = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in out) / len(out) > 0.97
    good, bad = ([r["score"] for r in out if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", 0), (None, "a b c", 5), (4, "a b", 3), (4, "a b", 3)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(4, 1), (2, 0), (None, 1), (1, None)], "doc_id long, quality int")
    out = fm.quality_scores(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["score"] == 0.5 for r in fm.quality_scores(docs, labels.limit(0)).collect())
    assert fm.quality_scores(docs.limit(0), labels).count() == 0


def test_bounds_names_and_long_texts(spark):
    words = lambda k, n: " ".join(f"{k}{i % 50}" for i in range(n))
    rows = [(f"d{i}", words("good" if i % 2 else "bad", 60), 1, i % 2) for i in range(60)] + [("d1", words("good", 60), 1, 1)] * 20 + [("long", words("good", 300_000), 1, 9), ("gap", " " * 2_000_000 + "x", 1, 9)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, n_chars long, QUALITY int")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(60)] + [("d1", 1)], "doc_id string, quality int")
    out = fm.quality_scores(docs, labels).collect()
    assert len(out) == len(rows) and {r["doc_id"] for r in out} == {r[0] for r in rows}
    known = fm.sample(labels, "doc_id", "quality")
    assert known.count() == 60
    renamed = docs.toDF("c0", "c1", "c2", "c3")
    assert fm.labelled_rows(renamed, known, "c0", "c1", ["c2"], 10**9).count() == 60
    some = fm.labelled_rows(renamed, known, "c0", "c1", ["c2"], 5000)
    assert 0 < some.count() < 30 and some.selectExpr("sum(octet_length(text))").first()[0] <= 5000
