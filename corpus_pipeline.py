"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, byte-level BPE.

Each stage works on all rows its predecessor kept, written as Parquet and read again.  All but the last return the columns of ``documents``;
``n_chars`` follows the text where lines go.

Defined cases: null and empty texts have no words, so the quality rules reject them; rows with null ids pass the stages as documents of their own, null languages and sources are groups of their own; texts of any
length run whole; of repeated rows (same id and text, a tie) one stays; an empty table gives an empty result; extra columns are carried up to the last stage whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialweave.llm import bpe, decontamination, jaccard_join, line_dedup, quality_rules
from trialweave.llm.text import numbered
from trialweave.plans.staging import release, staged, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _numbered(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns named by place, and the names of ``needed`` there: no other column can clash with a result of a stage."""
    rows, at, _ = numbered(docs, (), *needed)
    return rows, at


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their corpus' thresholds keep."""
    rows, (text, *keys) = _numbered(docs, "text", "lang", "source")
    return quality_rules.quality_rules(rows, text_col=text, keys=tuple(keys)).filter("kept").select(rows.columns).toDF(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines stay in one document each."""
    rows, (doc, text) = _numbered(docs, "doc_id", "text")
    edited = line_dedup.line_dedup(rows, id_col=doc, text_col=text)
    if "n_chars" in docs.columns:
        n = _numbered(docs, "n_chars")[1][0]
        edited = edited.withColumn(n, F.char_length(text).cast(rows.schema[n].dataType))
    return edited.select(rows.columns).toDF(*docs.columns)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id; one of repeated rows; rows without an id stay."""
    rows, (doc, text) = _numbered(docs, "doc_id", "text")
    labels = jaccard_join.jaccard_join(rows, id_col=doc, text_col=text, width=5, percent=80)
    first = staged(labels.filter(F.col(doc) == F.col("component_id")).select(doc).distinct(), "first")
    kept = rows.join(first, doc, "left_semi")
    copy = Window.partitionBy(doc, F.xxhash64(text)).orderBy(F.lit(0))
    kept = kept.withColumn("copy", F.row_number().over(copy)).filter("copy = 1").select(rows.columns)
    return kept.unionByName(rows.filter(F.col(doc).isNull())).toDF(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what stays, and their decoding, as digests."""
    import public_tokenizers

    vocab = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows, (doc, text) = _numbered(docs, "doc_id", "text")
    return bpe.digest(bpe.encode_decode(rows, vocab, id_col=doc, text_col=text).withColumnRenamed(doc, "doc_id"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_lines),
    ("jaccard_join", keep_first),
    ("decontamination", drop_leaks),
    ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; a stage's own tables go when its result is written, and its input with them."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
            release(spark, since, but=1)
    return docs


#: BPE isn't a matter of SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None
