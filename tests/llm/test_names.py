"""Columns that differ from the read ones in the case of letters only, and other odd names, change no result."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trialweave.llm import bpe, decontamination, factorisation, html_text, jaccard_join, language_id, line_dedup, packing, periodic, quality_rules, spelling, suffix_dedup, token_counts

ITEM = "Which river runs through the old town of the northern valley? It is the long Alder river."


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def exactly(df, *names):
    """Columns of just these names, of a result that keeps the caller's."""
    at = [df.columns.index(c) for c in names]
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).select(*[f"c{k}" for k in at]).toDF(*names)


def run(name, docs, pages, spark, vocab):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    if name == "op1":
        labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")
        return factorisation.quality_scores(docs, labels).select("doc_id", "held_out")
    if name == "op2":
        return jaccard_join.jaccard_join(docs)
    if name == "op3":
        return bpe.digest(bpe.encode_decode(docs, vocab))
    if name == "op4":
        return token_counts.replayed(docs, {"v": vocab}, restore=True)
    if name == "counted":
        return exactly(token_counts.counted(docs, {"v": vocab}), "doc_id", "v")
    if name == "op5":
        return language_id.identify(docs, pages).drop("confidence")
    if name == "op6":
        return line_dedup.digest(exactly(line_dedup.line_dedup(docs), "doc_id", "text", "n_lines", "n_dropped"))
    if name == "op7":
        return suffix_dedup.digest(suffix_dedup.suffix_dedup(docs))
    if name == "op8":
        return html_text.digest(html_text.extract(pages))
    if name == "op9":
        return exactly(quality_rules.quality_rules(docs, carry_text=False), "doc_id", "n_words", "kept")
    if name == "op10":
        return decontamination.contaminated(docs, items)
    if name == "op11":
        return spelling.variants(spelling.misspelt(spelling.words_of(docs), every=3), occurrences=1)
    if name == "op12":
        return periodic.digest(periodic.periodic_runs(periodic.echoed(docs)))
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        encoder = packing.Encoder(f.read(), vocab)
    return packing.pack(docs, encoder, carry=False).select("doc_id", "piece", "length", "ids_crc32")


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "counted", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13"])
def test_clashing_names(spark, vocab, name):
    docs = [(k, f"{ITEM} number {k % 4} " * (1 + k % 3), "en", "web", 100) for k in range(12)]
    pages = [(k, f"http://a.org/{k}", f"<article><p>words of page {k}</p></article>") for k in range(6)]
    plain_docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    plain_pages = spark.createDataFrame(pages, "page_id long, url string, html string")
    odd = lambda df: df.select("*", *[F.lit(f"other {c}").alias(c) for c in ("TEXT", "Doc_Id", "HTML", "Page_Id", "URL", "a.b", "__row", "Lang", "id", "row")])
    got, want = (run(name, d, p, spark, vocab) for d, p in ((odd(plain_docs), odd(plain_pages)), (plain_docs, plain_pages)))
    assert got.columns[: len(want.columns)] == want.columns
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
