import numpy as np

from trialweave.llm import decontamination as dc


def brute(docs, items, threshold=dc.THRESHOLD, overlap=dc.OVERLAP):
    """Every passage against every item, terms one by one."""
    split = {i: dc.text_words(t).tolist() for i, t in items if t}
    df = {}
    for w in split.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    n, mean = len(split), sum(map(len, split.values())) / len(split)
    widths = {i: next(x for x in (64 << k for k in range(30)) if x >= 2 * len(w)) for i, w in split.items()}
    out = set()
    for d, text in docs:
        words = dc.text_words(text or "").tolist()
        for width, lo in [(x, lo) for x in set(widths.values()) for lo in range(0, max(len(words) - x // 2, 1), x // 2)]:
            part = words[lo : lo + width]
            grams = {tuple(part[k : k + 3]) for k in range(len(part) - 2)}
            for i, t in items:
                if not t or not split[i] or widths[i] != width:
                    continue
                w = split[i]
                weight = {x: np.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in set(w)}
                if sum(v for x, v in weight.items() if x in set(part)) < threshold * sum(weight.values()):
                    continue
                if len(w) < dc.SHORT_WORDS:
                    if any(part[k : k + len(w)] == w for k in range(len(part))):
                        out.add((d, i))
                    continue
                shares = []
                for p in dc.parts(t):
                    p = dc.text_words(p).tolist()
                    g = {tuple(p[k : k + 3]) for k in range(len(p) - 2)}
                    shares.append(sum(x in grams for x in g) / len(g))
                if min(shares) >= overlap:
                    out.add((d, i))
    return out


def test_documents_equal_brute_force(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = dc.contaminated(docs, items).collect()
    rows = [tuple(r) for r in items.select("item_id", "text").collect()]
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], rows)
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert len(got) == len(want) > 0
    for shard_bytes in (1000, 4000):
        sharded = dc.contaminated(docs, items, shard_bytes=shard_bytes).collect()
        assert sorted(map(tuple, sharded)) == sorted(map(tuple, got))
    kept = dc.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()} - {d for d, _ in want}


def test_wand_equals_scoring_all():
    rng = np.random.default_rng(3)
    vocab = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab, int(rng.integers(8, 25))))) for i in range(40)]
    split = {i: dc.text_words(t).tolist() for i, t in items}
    df = {t: sum(t in w for w in split.values()) for w in split.values() for t in w}
    index = dc.Index(items, df, 40, 15.0)
    for _ in range(50):
        terms = np.unique(rng.integers(0, len(index.terms), 20))
        full = {}
        for t in terms.tolist():
            span = slice(index.start[index.lists[t]], index.start[index.lists[t + 1]])
            for k, x in zip(index.item[span].tolist(), index.impact[span].tolist(), strict=True):
                full[k] = full.get(k, 0) + x
        live = [b for _, b in index.live(terms, np.array([0, len(terms)]), 0.3)]
        got = dict(index.wand(terms, live[0], 0.3)) if live else {}
        # Skipped blocks hold nothing: cursors that stop at every block find the same.
        assert got == dict(index.wand(terms, np.arange(index.n_blocks), 0.3))
        assert set(got) == {k for k, s in full.items() if s >= 0.3}


def test_odd_rows(spark):
    item = "Which river runs through the old town of the northern valley? It is the long Alder river."
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "..."), (1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 300 + item.upper() + " y" * 300), (3, item), (None, item), (5, "which river runs through the old town")], "doc_id long, text string")
    assert {(r[0], r[1]) for r in dc.contaminated(docs, items).collect()} == {(3, 1), (None, 1)}
    assert dc.decontaminate(docs, items).count() == 3
    assert dc.contaminated(docs.limit(0), items).count() == 0
    around = spark.createDataFrame([(1, " "), (2, item), (3, ""), (4, "a b"), (5, None), (6, "...")], docs.schema).coalesce(1)
    assert {(r[0], r[1]) for r in dc.contaminated(around, items).collect()} == {(2, 1)}
    assert sorted(r[0] for r in dc.decontaminate(around, items).collect()) == [1, 3, 4, 5, 6]
    assert dc.contaminated(docs, items.limit(0)).count() == 0


def test_short_items_stand_in_a_row(spark):
    items = [(1, "Blue whale"), (2, "why"), (3, "one two three four five six seven"), (4, "Which river runs through the old town of the northern valley? The long Alder river.")]
    rows = [(1, "a blue, WHALE was here"), (2, "whale blue"), (3, "why not blue or whale"), (4, "x one two three four five six seven"), (5, "one two three four six five seven " * 40)]
    got = {(r[0], r[1]) for r in dc.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(rows, items) == {(1, 1), (3, 2), (4, 3)}


def test_ids_of_any_type_names_and_a_very_long_text(spark):
    item = "Which river runs through the old town of the northern valley? It is the long Alder river."
    items = spark.createDataFrame([("q1", item)], "item_id string, text string")
    filler = "some other words of no test " * 100_000
    docs = spark.createDataFrame([("d1", filler + item + " " + filler, 1, 2), ("d2", filler, 3, 4), ("d3", "W" * 1_000_000, 5, 6)], "doc_id string, text string, ID int, item_id int")
    got = dc.contaminated(docs, items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [("d1", "q1")]
    kept = dc.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted((r[0], r[2], r[3]) for r in kept.collect()) == [("d2", 3, 4), ("d3", 5, 6)]


def test_memory_follows_the_postings():
    rng = np.random.default_rng(0)
    items = [(i, " ".join(f"w{x}" for x in rng.zipf(1.2, 30) % 100_000)) for i in range(2000)]
    df = {}
    for _, t in items:
        for w in set(dc.text_words(t).tolist()):
            df[w] = df.get(w, 0) + 1
    index = dc.Index(items, df, len(items), 30.0)
    arrays = sum(x.nbytes for x in (index.terms, index.item, index.impact, index.start, index.block, index.most, index.lists))
    assert arrays <= 48 * len(index.item)


def test_no_item_changes_what_another_finds(spark):
    q, a = "Which river runs through the old town of the northern valley", "It is the long and winding Alder river"
    items = [(1, f"{q}? {a}."), (2, "The tallest tower of the eastern harbour was built by whom? By the guild of masons in the ninth year.")]
    far = " ".join(f"x{k}" for k in range(400))
    rows = [(1, f"{q} {far} {a}"), (2, f"{far} {q}? {a}. {far}"), (3, items[1][1]), (4, far)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    long = (3, " ".join(f"w{k}" for k in range(10_000)) + ". And the answer is " + " ".join(f"v{k}" for k in range(5_000)))
    middle = (4, " ".join(f"m{k}" for k in range(60)) + "? " + " ".join(f"n{k}" for k in range(40)))
    sets = []
    for extra in ([], [long], [middle, long]):
        got = {(r[0], r[1]) for r in dc.contaminated(docs, spark.createDataFrame(items + extra, "item_id long, text string")).collect()}
        assert got == brute(rows, items + extra)
        sets.append(got)
    assert sets == [{(2, 1), (3, 2)}] * 3
    leaked = spark.createDataFrame([(9, f"{far} {long[1]} {far}"), (8, f"{far} {middle[1]}")], docs.schema)
    assert {(r[0], r[1]) for r in dc.contaminated(leaked, spark.createDataFrame([*items, long, middle], "item_id long, text string")).collect()} == {(9, 3), (8, 4)}
