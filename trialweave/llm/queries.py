"""The registered queries of the corpus operators, one for each, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trialweave.llm import bpe, decontamination, factorisation, html_text, jaccard_join, language_id, line_dedup, packing, periodic, quality_rules, spelling, suffix_dedup, token_counts


def op1_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    return factorisation.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_join.jaccard_join(docs, width=4, percent=85)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocab = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe.digest(bpe.encode_decode(docs, vocab))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocab = {v: bpe.vocabulary(public_tokenizers.path(f"{v}.tiktoken"), public_tokenizers.PATTERN) for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    return token_counts.replayed(docs, vocab, restore=True)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return language_id.identify(docs, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup.digest(line_dedup.line_dedup(docs))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(docs))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.digest(html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return quality_rules.digest(quality_rules.quality_rules(docs, carry_text=False))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling.variants(spelling.misspelt(spelling.words_of(docs)))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return periodic.digest(periodic.periodic_runs(periodic.echoed(docs)))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = packing.Encoder(f.read(), bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packing.digest(packing.pack(docs, encoder, carry=False))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_factorisation_machine, op2_jaccard_join, op3_byte_bpe, op4_token_counts, op5_language_id, op6_line_dedup, op7_suffix_dedup, op8_html_text, op9_quality_rules, op10_decontamination, op11_spelling_variants, op12_periodic_runs, op13_best_fit_packing, pipeline)}

ORACLE_SQL: dict[str, str] = {"op6_line_dedup": line_dedup.ORACLE, "op9_quality_rules": quality_rules.ORACLE}
