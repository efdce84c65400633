import random
import re
import zlib
from collections import Counter

import pytest

from trialweave.llm import spelling


def lowered(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def plain_words(docs, every=199):
    out = []
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lowered(run)
            h = zlib.crc32(f"{doc}:{w}".encode())
            out.append(w[: h % len(w)] + w[h % len(w) + 1 :] if doc is not None and h % every == 0 else w)
    return out


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(words, letters=6, occurrences=5, times=5):
    n = {w: c for w, c in Counter(words).items() if len(w) >= letters and c >= occurrences}
    cells = {}
    for w in n:  # words at distance one share a deletion or are one
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            cells.setdefault(key, []).append(w)
    close = {w: set() for w in n}
    for group in cells.values():
        for a in group:
            close[a].update(b for b in group if near(a, b))
    best = {w: min(close[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= times * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(close[w]), n[form[w]] if form[w] else None) for w in n)


def same(got):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect())


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_reading(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abÀé") for _ in range(rng.randrange(2, 9))) for _ in range(12)]
    words = []
    for _ in range(4000):
        w = rng.choice(base)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3])):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice("abÀ") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abÀ") + w[i + 1 :]])
        words += [w] * rng.choice([1, 1, 1, 30])
    got = spelling.variants(spark.createDataFrame([(w,) for w in words], "word string"), letters=3, occurrences=2, times=3)
    assert same(got) == plain(words, 3, 2, 3)


def test_query_equals_plain_reading(spark, sf):
    from trialweave.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_spelling_variants"](spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert same(got) == plain(plain_words(docs))


def test_chains_ties_and_hubs(spark):
    n = {"abcdef": 5000, "abcdeg": 5000, "abcdefx": 900, "abcdefxy": 100, "abcdefxyz": 10, "zzzzzz": 7, **{"hub" + a + b: 5 for a in "abcdefghij" for b in "klmnopqrst"}, "hubbbk": 400}
    words = [w for w, c in n.items() for _ in range(c)]
    got = spelling.variants(spark.createDataFrame([(w,) for w in words], "word string"), letters=5)
    assert same(got) == plain(words, 5)
    assert {r["word"]: r["root"] for r in got.collect()}["abcdefxyz"] == "abcdef"


def test_odd_rows_and_long_words(spark):
    long = "ab" * 150_000
    rows = [(None, "Häuser häuser " * 3), ("a", None), ("b", ""), ("c", "12 + ?"), ("d", f"{long} {long[:-1]} x{long} {long}q")]
    rows += [("d", f"{long} {long}"), ("e", " ".join([long] * 20)), ("d", f"{long[:-1]} x{long} {long}q")]
    df = spark.createDataFrame([(*r, "t", "u") for r in rows * 3], "doc_id string, text string, TEXT string, `a.b` string")
    words = plain_words(rows * 3)
    assert same(spelling.variants(spelling.misspelt(spelling.words_of(df)))) == plain_long(words, long)
    assert spelling.variants(spelling.misspelt(spelling.words_of(df.limit(0)))).count() == 0


def plain_long(words, long):
    """As plain, for words that are too long to write down their deletions."""
    n = {w: c for w, c in Counter(words).items() if len(w) >= 6 and c >= 5}
    close = {w: [x for x in n if x != w and (w.startswith(x) or w.endswith(x) or x.startswith(w) or x.endswith(w)) and abs(len(x) - len(w)) == 1] for w in n}
    top = max(n, key=n.get)
    assert top == long
    out = []
    for w in n:
        form = min(close[w], key=lambda x: (-n[x], x), default=None)
        form = form if form and n[form] >= 5 * n[w] else None
        out.append((w, form or "", form or w, n[w], len(close[w]), n[form] if form else None))
    return sorted(out)
