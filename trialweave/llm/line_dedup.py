"""Line deduplication over a corpus, with DataFrame functions only.

Every text is split at ``\\n``.  A line's key is the line stripped of white space at both ends with A-Z
lowered; keys of at least ``min_chars`` code points are hashed to 128 bits.  Keys found in at least
``min_docs`` documents lose their lines in every document but the one of the largest id.  What stays is
joined again by position.

Plan: lines (id, position, hash), no text, are shuffled by hash for the count (the distinct count is
pre-aggregated by (hash, id), so a line that a third of all documents hold leaves each task as one row
a document and is then summed by task) and again to meet the frequent hashes, which are staged: Spark broadcasts
a small table of them, else it splits skewed partitions of the join.  Positions to drop go back to their document; texts move once.

Defined cases: null or empty text is one empty line; rows of the same id count as one document (ties of the largest id keep all its lines), each row
is edited by its own text; null ids count together as one document, below every other; ids may be of any type with an order; a text of any length is one
row, split where it is; an empty table gives an empty result; input columns of the result's names, in any case of letters, are replaced, all others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm.text import ascii_lower, let, numbered, strip, whole
from trialweave.plans.staging import staged


def _lines(text: Column) -> Column:
    return F.split(whole(text), "\n", -1)


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """A row for each line whose key is long enough: __id, __row, __pos, __h1, __h2."""
    lines = docs.select(
        F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__row"), F.posexplode(_lines(F.col(text_col))).alias("__pos", "__line")
    ).filter(F.char_length("__line") >= min_chars)
    keys = lines.select("__id", "__row", "__pos", ascii_lower(strip(F.col("__line"))).alias("__key"))
    return keys.filter(F.char_length("__key") >= min_chars).select(
        "__id", "__row", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit("line"), "__key").alias("__h2")
    )


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with its edited text, ``n_lines`` (before dropping) and ``n_dropped``."""
    rows, (doc, text), names = numbered(docs, ("n_lines", "n_dropped"), id_col, text_col)
    # Lines are split and hashed once.  The frequent ones are written too: a small table is broadcast, and a large one is an exchange of its own, so that Spark can split a hot line's rows.
    lines = staged(line_hashes(rows, doc, text, min_chars), "line-hashes")
    one = F.struct("__id")  # a null id counts too
    frequent = staged(
        lines.groupBy("__h1", "__h2")
        .agg(F.count_distinct(one).alias("__docs"), F.max(one).alias("__keep"))
        .filter(F.col("__docs") >= min_docs)
        .select(F.col("__h1").alias("__f1"), F.col("__h2").alias("__f2"), F.col("__keep.__id").alias("__keep")),
        "lines",
    )
    drops = (
        lines.join(frequent, (F.col("__h1") == F.col("__f1")) & (F.col("__h2") == F.col("__f2")))
        .filter(~F.col("__id").eqNullSafe(F.col("__keep")))
        .groupBy(F.col("__id").alias("__did"), F.col("__row").alias("__drow"))
        .agg(F.collect_set("__pos").alias("__drops"))
    )
    rest = let(
        _lines(F.col(text)),
        lambda lines: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drops")), lambda i: F.get(lines, i)), "\n"
        ),
    )
    joined = rows.withColumn("__row", F.xxhash64(text)).join(drops, F.col(doc).eqNullSafe(F.col("__did")) & (F.col("__row") == F.col("__drow")), "left")
    full = whole(F.col(text))
    return joined.select(
        *[F.col(c) for c in names if c != text],
        F.when(F.col("__drops").isNull(), full).otherwise(rest),
        (F.char_length(full) - F.char_length(F.replace(full, F.lit("\n"))) + 1).cast("long"),
        F.coalesce(F.size("__drops"), F.lit(0)).cast("long"),
    ).toDF(*[n for c, n in names.items() if c != text], text_col, "n_lines", "n_dropped")


def digest(edited: DataFrame) -> DataFrame:
    return edited.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM docs),
keys AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key, max(doc_id) AS keep FROM keys WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, CAST(count(*) AS BIGINT) AS n_lines,
  CAST(count(*) FILTER (f.key IS NOT NULL AND f.keep <> k.doc_id) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (f.key IS NULL OR f.keep = k.doc_id), '')) AS kept_sha256
FROM keys k LEFT JOIN frequent f ON f.key = k.key GROUP BY k.doc_id
"""
