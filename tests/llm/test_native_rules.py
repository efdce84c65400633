import random

import duckdb
from pyspark.sql import functions as F

from trialweave.llm import line_dedup, quality_rules


def both(spark, rows, run, oracle, schema="doc_id long, text string, lang string, source string"):
    df = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, run(df).collect()), key=str)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    if rows:
        con.executemany("insert into documents values (?, ?, ?, ?)", [tuple(r) for r in rows])
    return got, sorted(con.execute(oracle).fetchall(), key=str)


def corpus(seed):
    rng = random.Random(seed)
    pool = ["  " * rng.randrange(3) + "".join(rng.choice("abcDEFé ") for _ in range(n)) + "\r" * rng.randrange(2) for n in (38, 40, 41, 42, 60, 80, 0, 3)]
    rows = []
    for d in range(80):
        lines = [rng.choice(pool).swapcase() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randrange(12))]
        rows.append((d, "\n".join(lines), rng.choice(["en", "de", None]), rng.choice(["s", "t", None])))
    return [*rows, (100, None, "en", "s"), (101, "", None, None), (102, "w " * 3000, "en", "s"), (103, "a b c\na b c\n | # $ % a b c", "en", "s")]


def test_line_dedup(spark):
    for seed in (0, 1):
        rows = corpus(seed)
        got, want = both(spark, rows, lambda df: line_dedup.digest(line_dedup.line_dedup(df)).select("doc_id", "n_lines", "n_dropped", "kept_sha256"), f"select doc_id, n_lines, n_dropped, kept_sha256 from ({line_dedup.ORACLE})")
        assert got == want


def test_line_dedup_keeps_other_columns_and_repeated_ids(spark):
    line = "a line that is certainly long enough to count here"
    rows = [(i, line, "x") for i in (1, 2, 3, 4, 5, 5)] + [(None, line + "\nrest", "x")]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, n_lines string")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in out) == sorted([*[(str(i), "") for i in (1, 2, 3, 4)], ("5", line), ("5", line), ("None", "rest")])
    assert line_dedup.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_quality_rules(spark):
    columns = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept"
    for seed in (0, 1):
        got, want = both(spark, corpus(seed), lambda df: quality_rules.digest(quality_rules.quality_rules(df)), f"select {columns} from ({quality_rules.ORACLE})")
        assert got == want
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, kept string")
    assert quality_rules.quality_rules(empty).count() == 0


def test_sketches_merge_to_the_same_quantiles(spark):
    values = spark.range(5000).select((F.col("id") % 7).alias("k"), (F.pow(F.col("id") % 997, 2)).cast("long").alias("v"))
    parts = quality_rules.sketches(values, ["k"], ["v"])
    whole = quality_rules.quartiles(quality_rules.merged(parts, []), []).first()
    direct = quality_rules.quartiles(quality_rules.sketches(values, [], ["v"]), []).first()
    assert whole == direct
    exact = sorted((i % 997) ** 2 for i in range(5000))
    for q, at in ((25, "q25"), (75, "q75")):
        true = exact[-(-5000 * q // 100) - 1]
        assert true * (1 - 1 / 32) <= whole[at] <= true


def test_names_that_clash(spark):
    """Columns of a caller named as results, in another case of letters, or as working columns."""
    line = "a line that is certainly long enough to count here"
    columns = ["doc_id", "text", "lang", "source", "N_Words", "KEPT", "__row", "__l", "__w", "c0", "c1", "a b.c", "__keep", "n_Lines"]
    schema = ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in columns)
    rows = [(i, line, "en", "s", *[f"mine {c} {i}" for c in columns[4:]]) for i in range(6)]
    df = spark.createDataFrame(rows, schema)
    out = line_dedup.line_dedup(df)
    assert set(out.columns) == {c for c in columns if c != "n_Lines"} | {"n_lines", "n_dropped"}
    for r in out.collect():
        assert all(r[c] == f"mine {c} {r['doc_id']}" for c in columns[4:-1])
        assert r["text"] == (line if r["doc_id"] == 5 else "")
    out = quality_rules.quality_rules(df)
    assert {c for c in columns if c.lower() not in ("n_words", "kept", "n_lines")} < set(out.columns)
    for r in out.collect():
        assert all(r[c] == f"mine {c} {r['doc_id']}" for c in ("__row", "__l", "__w", "c0", "c1", "a b.c"))
        assert r["n_words"] == 10 and r["base_failed"] and not r["kept"]


def test_ids_of_any_type_and_a_very_long_text(spark):
    line = "a line that is certainly long enough to count here"
    long = "\n".join(f"{line} {i}" for i in range(100_000))
    rows = [(f"d{i}", line) for i in range(4)] + [("e", long + "\n" + line)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(df).collect()}
    assert out["e"]["n_lines"] == 100_001 and out["e"]["n_dropped"] == 0 and out["d3"]["text"] == ""
    measured = {r["doc_id"]: r for r in quality_rules.quality_rules(df.selectExpr("*", "'en' lang", "null source")).collect()}
    assert measured["e"]["n_words"] == 1_100_010 and measured["e"]["n_dup_lines"] == 0
