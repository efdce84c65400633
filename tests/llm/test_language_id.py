import math

import numpy as np
from pyspark.sql import functions as F

from trialweave.llm import language_id as li


def test_languages_of_documents_and_pages(spark):
    sf = "/root/testdata/sf0.01"
    docs, pages = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/pages.parquet")
    out = li.identify(docs, pages, max_train=300)
    rows = out.filter("kind = 'document'").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert sum(r["language"] == r["lang"] for r in rows) / len(rows) > 0.97
    rows = out.filter("kind = 'page'").collect()
    assert len(rows) == pages.count()
    assert sum(r["language"] == r["declared"] for r in rows) / len(rows) > 0.9


def brute(rows, k):
    """The same fusion, in plain loops."""
    p = []
    for r in rows:
        e = [math.exp(x - max(r["ll"])) for x in r["ll"]]
        p.append([x / sum(e) for x in e])

    def sums(pick, i):
        key = pick(rows[i])
        out = [0.0] * k
        for j, r in enumerate(rows):
            if pick(r) == key:
                out = [a + b for a, b in zip(out, p[j], strict=True)]
        return [max(a - b, 0) for a, b in zip(out, p[i], strict=True)], out

    site = lambda h: ".".join(h.split(".")[-2:]) if h.count(".") else ""
    result = []
    for i, r in enumerate(rows):
        own, every = sums(lambda r: 0, i)
        q = [x + li.SMOOTH for x in own]
        q = [x / sum(q) for x in q]
        for pick in (lambda r: r["kind"], lambda r: (r["kind"], site(r["host"])), lambda r: (r["kind"], r["host"])):
            s, _ = sums(pick, i)
            q = [(a + li.PULL * b) / (sum(s) + li.PULL) for a, b in zip(s, q, strict=True)]
        post = [x + math.log(y) for x, y in zip(r["ll"], q, strict=True)]
        for name in ("declared", "suffix"):
            if r[name] is not None:
                s, _ = sums(lambda r, name=name: r[name], i)
                post = [x + math.log((a + li.SMOOTH) / (g + 1)) for x, a, g in zip(post, s, every, strict=True)]
        e = [math.exp(x - max(post)) for x in post]
        result.append(max(e) / sum(e))
    return result


def test_fusion_equals_plain_loops(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(40):
        rows.append({"kind": rng.choice(["page", "document"]).item(), "i": i, "host": rng.choice(["a.x.org", "b.x.org", "c.net", "", "s1"]).item(), "declared": rng.choice([None, "en", "de"]), "suffix": rng.choice([None, "fr"]), "ll": rng.normal(0, 2, 3).tolist()})
    df = spark.createDataFrame(rows, "kind string, i int, host string, declared string, suffix string, ll array<double>")
    got = {r["i"]: r["confidence"] for r in li.fused(df, ["de", "en", "fr"]).collect()}
    for i, want in enumerate(brute(rows, 3)):
        assert abs(got[i] - want) < 1e-9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "der die das und", "de", "s"), (2, "the of and to", "en", "s"), (3, None, None, None), (None, "", "en", "s"), (2, "the of and to", "en", "s")], "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([(1, None, None), (2, "http://x.de/", ""), (3, "https://fr.x.org/de/1", "<html lang='de-AT'><p>der die</p>")], "page_id long, url string, html string")
    out = li.identify(docs, pages).collect()
    assert len(out) == 8 and all(r["language"] in ("de", "en") for r in out)
    r = next(r for r in out if r["page_id"] == 3)
    assert (r["language"], r["declared"], r["suffix"]) == ("de", "de", "de")
    assert next(r for r in out if r["page_id"] == 2)["suffix"] == "de"
    assert all(r["language"] is None for r in li.identify(docs.withColumn("lang", F.lit(None).cast("string")), pages).collect())
    assert li.identify(docs.limit(0), pages.limit(0)).count() == 0


def test_ids_names_and_long_texts(spark):
    docs = spark.createDataFrame([("a", "der die das und nicht " * 100, "de", "s", "x"), ("b", "the of and to with " * 200_000, "en", "s", "y"), ("c", " " * 1_000_000, None, "s", "z")], "doc_id string, text string, lang string, source string, Language string")
    pages = spark.createDataFrame([("p", "http://x.de/", "<p>" + "das und die " * 100_000 + "</p>", 1)], "page_id string, url string, html string, kind int")
    out = {(r["doc_id"], r["page_id"]): r["language"] for r in li.identify(docs, pages).collect()}
    assert len(out) == 4 and out["a", None] == "de" and out["b", None] == "en" and out[None, "p"] == "de"


def test_declarations():
    from trialweave.llm.language_id import declared_language

    assert declared_language("<!DOCTYPE html><HTML class=x lang = 'de-AT'><p>") == "de"
    assert declared_language("<html><meta charset=x><meta http-equiv=content-language content=fr><html lang=en>") == "fr"
    assert declared_language("<html dir=ltr> lang=en <p lang=es>") is None
    assert declared_language("<html lang=it") == "it"
    assert declared_language("") is None and declared_language(None) is None
