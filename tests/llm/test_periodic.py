import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from trialweave.llm import periodic


def plain_runs(w, least=12):
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1) if j > i else i + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_row(doc, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if plant and doc is not None and w:
        h = zlib.crc32(str(doc).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def texts(seed, n=60):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(0, 6)):
            block = [rng.choice("abc" if rng.random() < 0.5 else "abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([1, 2, 3, 7, 20, 40]))]
            w += (block * 9)[: rng.randrange(1, 6 * len(block))] if rng.random() < 0.6 else block
        out.append(rng.choice([" ", "\n", " \t"]).join(w))
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("lags", [periodic.LAGS, 9])
def test_equals_plain_reading(spark, seed, lags):
    rows = list(enumerate(texts(seed)))
    got = periodic.digest(periodic.periodic_runs(periodic.echoed(spark.createDataFrame(rows, "doc_id long, text string")), lags=lags)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_row(*r) for r in rows)


def test_query_equals_plain_reading(spark, sf):
    from trialweave.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_periodic_runs"](spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_row(*r) for r in docs)


def test_kernel_on_random_ids():
    rng = np.random.default_rng(5)
    for _ in range(150):
        sizes = np.sort(rng.integers(0, 120, 4))[::-1]
        parts = [np.tile(rng.integers(0, 3, int(rng.integers(1, 30))), 9)[:n] if rng.random() < 0.7 else rng.integers(0, 2, n) for n in sizes]
        for p in parts:
            if len(p) > 4 and rng.random() < 0.5:
                p[int(rng.integers(0, len(p)))] = 7
        parts.sort(key=len, reverse=True)
        sizes = np.array([len(p) for p in parts])
        g = np.concatenate([p + 10 * k for k, p in enumerate(parts)])
        at = np.cumsum(sizes) - sizes
        want = sorted((int(a) + s, int(a) + s + n, q) for a, p in zip(at, parts, strict=True) for s, n, q in plain_runs(p.tolist()))
        assert [tuple(r) for r in periodic.find_runs(g, sizes).tolist()] == want


def test_odd_rows(spark):
    rows = [(None, "a " * 30), (1, None), (2, ""), (3, " \n"), (4, "x"), (4, "x y " * 8), (4, "x y " * 8), (5, "é é " * 12)]
    df = spark.createDataFrame([(*r, "t", "d") for r in rows], "doc_id string, text string, TEXT string, `a.b` string")
    got = periodic.periodic_runs(df).collect()
    by = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got)
    assert by == sorted([("None", 30, [(0, 30, 1)], "a"), ("1", 0, [], ""), ("2", 0, [], ""), ("3", 0, [], ""), ("4", 1, [], "x"), ("4", 16, [(0, 16, 2)], "x y"), ("4", 16, [(0, 16, 2)], "x y"), ("5", 12, [(0, 12, 1)], "é é")])
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    assert periodic.echoed(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(1)
    block = [str(rng.randrange(10**6)) for _ in range(70_000)]
    long = "q " * 400_000
    df = spark.createDataFrame([(1, " ".join(block * 3)), (2, long), (3, "x" * 2_000_000)], "doc_id long, text string")
    got = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(df).collect()}
    assert got == {1: ([(0, 210_000, 70_000)], " ".join(block)), 2: ([(0, 400_000, 1)], "q"), 3: ([], "x" * 2_000_000)}
