import random

import numpy as np
import pytest

from trialweave.llm import suffix_dedup as sd


def brute(rows, length):
    seen = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for k, (_, b) in enumerate(data):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((k, i))
    gone = [np.zeros(len(b), bool) for _, b in data]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + length] = True
    out = []
    for (d, b), g in zip(data, gone, strict=True):
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], g.astype(int)))) == 1))
        out.append((d, len(b), int(g.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~g]) if len(b) else b""))
    return sorted(out, key=str)


def check(spark, rows, kind="long", **more):
    got = sd.suffix_dedup(spark.createDataFrame(rows, f"doc_id {kind}, text string"), **more).collect()
    for least, most in ((more.get("gram", sd.GRAM), False), (more.get("passage", sd.PASSAGE), True)):
        held = {}
        for d, t in set(rows):
            b = (t or "").encode()
            for i in range(len(b) - least + 1):
                held.setdefault(b[i : i + least], set()).add((d, t))
        sharing = {x for v in held.values() if len(v) > 1 for x in v}
        for r in got:
            mine = [x for x in sharing if x[0] == r[0] and x[1] and len(x[1].encode()) == r[1]]
            assert r["shares_passage"] >= bool(mine) if most else r["shares_passage"] <= bool(mine)
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got), key=str) == brute(rows, more.get("length", sd.LENGTH))


def test_collection_equals_sorted_suffixes():
    rng = np.random.default_rng(0)
    for _ in range(20):
        docs = [rng.integers(0, 3, int(rng.integers(0, 30))) for _ in range(int(rng.integers(1, 8)))]
        doc, off, lcp = sd.collection(docs)
        # an end sorts below every symbol, ends among themselves by document
        suffix = lambda d, o: [*((1, int(x)) for x in docs[d][o:]), (0, d)]
        want = sorted(((d, o) for d in range(len(docs)) for o in range(len(docs[d]) + 1)), key=lambda x: suffix(*x))
        assert list(zip(doc.tolist(), off.tolist(), strict=True)) == want
        for k in range(1, len(want)):
            a, b = suffix(*want[k - 1]), suffix(*want[k])
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), 0)
            assert lcp[k] == n


def test_hashes_of_any_width():
    buf = np.random.default_rng(3).integers(0, 3, 400).astype(np.uint8)
    with np.errstate(over="ignore"):
        for gram in (1, 2, 3, 16, 24, 29, 192):
            h = sd._hashes(buf, gram)
            assert len(h) == len(buf) - gram + 1
            assert len(set(h.tolist())) == len({buf[i : i + gram].tobytes() for i in range(len(h))})


def test_hot_hashes(spark, monkeypatch):
    """A passage in many different surroundings, dealt to blocks."""
    monkeypatch.setattr(sd, "BLOCK_BYTES", 400)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    hot, twice = text(70), text(50)
    rows = [(f"d{i}", text(rng.randrange(50)) + hot + text(rng.randrange(50))) for i in range(60)]
    rows += [("x", text(20) + twice), ("y", twice + text(9)), (None, hot), (None, hot), ("z", hot + hot)]
    check(spark, rows, "string", length=40, gram=16, passage=30)


def test_a_very_long_text(spark):
    rng = random.Random(6)
    part = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    long = "".join(rng.choice("abcdefgh ") for _ in range(3_000_000))
    rows = [(1, long + part + long[:1000]), (2, part), (3, "n" * 1_000_000)]
    got = {r[0]: r for r in sd.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 7000 and got[1]["n_spans"] == 2
    assert got[2]["n_removed"] == 5000 and got[3]["n_removed"] == 1_000_000 and bytes(got[3]["kept"]) == b""


def test_scratch_files(monkeypatch):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 2, 40) for _ in range(5)]
    plain = sd.collection(docs)
    monkeypatch.setattr(sd, "SPOOL", 16)
    for a, b in zip(plain, sd.collection(docs), strict=True):
        assert a.tolist() == np.asarray(b).tolist()


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    parts = [text(n) for n in (30, 70, 90, 150, 400, 39, 40, 41)]
    rows = [(i, "".join(rng.choice(parts) if rng.random() < 0.5 else text(rng.randrange(60)) for _ in range(rng.randrange(8)))) for i in range(60)]
    rows += [(100, "ab" * 200), (101, "x" * 300), (102, "0123456789" * 9), (103, None), (104, ""), (105, "zz" + "y" * 41), (7, rows[7][1]), (None, rows[9][1]), (None, rows[9][1])]
    check(spark, rows, length=40, gram=16, passage=24)


def test_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_empty(spark):
    assert sd.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
