import hashlib
import re

import corpus_pipeline
import duckdb

from tests.llm.test_bpe import library
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_jaccard_join import brute as groups
from trialweave.llm import line_dedup, quality_rules


def test_run_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    con = duckdb.connect()
    con.execute(f"create table documents as select * from '{sf}/documents.parquet'")
    kept = [r[0] for r in con.execute(f"select doc_id from ({quality_rules.ORACLE}) where kept").fetchall()]
    con.execute("create table k as select unnest(?) as doc_id", [kept])
    rows = con.execute("select doc_id, text from documents where doc_id in (select doc_id from k) order by doc_id").fetchall()
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for d, t in rows:
        for line in t.split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(d)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    rows = [(d, "\n".join(x for x in t.split("\n") if gone.get(key(x), d) == d)) for d, t in rows]
    first = {d for d, _, c in groups(rows, 5, 80) if d == c}
    rows = [(d, t) for d, t in rows if d in first]
    items = con.execute(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    leaked = {d for d, _ in leaks(rows, items)}
    enc = library()
    assert set(got) == {d for d, _ in rows} - leaked
    for d, t in rows:
        if d not in leaked:
            ids = enc.encode_ordinary(t)
            assert got[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert got[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert 0 < len(got) < 1000


def test_stages_return_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(3).unionByName(spark.createDataFrame([(None, None, None, None, None), (5, "", "en", "s", 0)], docs.schema))
    for data in (odd, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, data, sf)
            assert out.columns == docs.columns
            out.count()
    assert line_dedup.ORACLE


def test_extra_columns_and_very_long_texts(spark):
    sf = "/root/testdata/sf0.001"
    columns = ["doc_id", "text", "lang", "source", "n_chars", "Kept", "n_words", "DOC_ID2", "__row", "copy", "component_id", "c0"]
    schema = ", ".join(f"`{c}` {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in columns)
    prose = " ".join(f"{a}{b}" for a in ("one", "two", "three", "four", "five") for b in ("al", "en", "or", "is", "um", "ta", "ro", "li", "ve", "ne", "so"))
    texts = [prose, prose + " " * 2_000_000 + "end", "\n".join(f"{prose} {i}" for i in range(20_000)), "#" * 2_000_000, prose + " " + "a" * 2_000_000, None]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *[f"mine {c}" for c in columns[5:]]) for i, t in enumerate(texts)], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        assert all(r[c] == f"mine {c}" for r in docs.collect() for c in columns[5:])
    out = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(out) == set(rows) and rows
    for d, t in rows.items():
        assert out[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
