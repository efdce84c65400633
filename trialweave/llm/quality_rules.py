"""Quality rules whose thresholds come from the corpus: a mergeable quantile sketch for each language and source.

The sketch of a measure is a histogram over buckets of bounded relative width: a whole number below 64 is its own
bucket; a larger one keeps its six leading bits.  Counts of a bucket add up, so sketches of tasks, sources and
languages merge by summing in any order, and the result is the same on every run (no random compaction).
A quantile read from it is at most 1/32 too small.

For each measure the fence is ``q75 + k * max(q75 - q25, least spread)``; for the mean word length there is
also a lower one.  A (language, source) with fewer than ``min_group`` documents takes the sketch merged over its
language, a language with fewer takes the one merged over everything.  Documents beyond a fence go; so do
those that fail the base rules (fewer than ``min_words`` words, or over half of the words in repeated 3-word windows).

Everything runs in DataFrame functions.  The measures are computed once and staged; sketches hold at most a few
hundred buckets for each group and measure, pre-aggregated before the shuffle, so a hot source is a few hundred rows a task.

Defined cases: a null or empty text has no words and fails; null languages and sources are groups of their own; a text of any length is measured whole, in its row;
repeated rows each count; a value at a fence (a tie) is inside; an empty table gives an empty result; ids aren't looked at; input columns named as results, in any case of letters,
are replaced, all others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.text import SPACE_CLASS, let, numbered, whole
from trialweave.plans.staging import staged

#: Measure, its whole-number value, the least spread of its fences, whether it has a lower fence.
MEASURES = {
    "symbols": ("10000 * n_symbols div greatest(word_chars, 1)", 200, False),
    "word_length": ("1000 * word_chars div greatest(n_words, 1)", 1000, True),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", 150, False),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", 150, False),
}
FENCE = 3
MIN_GROUP = 100


#: Columns of :func:`measured`.
MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def _repeat_words(ws: Column) -> Column:
    """How many words stand in a 3-word window that is found twice or more."""

    def windows(w: Column) -> Column:
        return F.sort_array(
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        )

    def repeated(s: Column) -> Column:
        h = lambda i: F.get(s, i)["h"]
        starts = F.transform(
            F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(h(i) == h(i - 1), F.lit(False)) | F.coalesce(h(i) == h(i + 1), F.lit(False))),
            lambda i: F.get(s, i)["i"],
        )
        return F.sort_array(starts)

    def covered(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)

    some = let(let(windows(ws), repeated), lambda p: F.when(F.size(p) == 0, 0).otherwise(covered(p)))
    return F.when(F.size(ws) < 3, 0).otherwise(some).cast("long")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``, whose columns bear none of these names, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (those with a word)."""
    text = whole(F.col(text_col))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    counted = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r")))
    ls = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    first = docs.select(
        *docs.columns,
        counted.alias("__w"),
        ls.alias("__l"),
        F.char_length(F.regexp_replace(text, SPACE_CLASS + "+", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    return first.select(
        *[c for c in first.columns if c not in ("__w", "__l")],
        F.col("__w.n").alias("n_words"), F.col("__w.r").alias("n_repeat_words"), F.col("__l.d").alias("n_dup_lines"), F.col("__l.n").alias("n_lines"),
    )


def bucket(v: Column) -> Column:
    """Shift * 64 + the six leading bits."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (shift * 64 + F.call_function("shiftright", v, shift)).cast("int")


def sketches(measures: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Counts of each bucket for each group: keys, measure, bucket, n."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in names])
    return measures.select(*keys, F.explode(pairs).alias("p")).groupBy(*keys, "p.measure", "p.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches summed over all keys but these."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, total, q25, q75: the least value of the bucket that holds the rank."""
    w = Window.partitionBy(*keys, "measure")
    low = F.call_function("shiftleft", (F.col("bucket") % 64).cast("long"), F.call_function("div", F.col("bucket"), F.lit(64)).cast("int"))
    ranked = sketch.withColumns({"total": F.sum("n").over(w), "cum": F.sum("n").over(w.orderBy("bucket")), "low": low})
    at = lambda q: F.min(F.when(F.col("cum") * 100 >= F.col("total") * q, F.col("low")))
    return ranked.groupBy(*keys, "measure").agg(F.max("total").alias("total"), at(25).alias("q25"), at(75).alias("q75"))


def fences(sketch: DataFrame, keys: list[str], fence: int, min_group: int) -> DataFrame:
    """keys and, for each measure, its fences <measure>_lo and _hi, from the finest level with enough documents."""
    levels = [quartiles(merged(sketch, keys[:k]), keys[:k]).select(
        *[F.col(c).alias(f"__{k}_{c}") for c in keys[:k]], F.col("measure").alias(f"__{k}_m"), *[F.col(c).alias(f"__{k}{c}") for c in ("total", "q25", "q75")]
    ) for k in range(len(keys), -1, -1)]
    out = levels[0]
    n = len(keys)
    for k, level in zip(range(n - 1, -1, -1), levels[1:], strict=True):
        on = F.col(f"__{n}_m") == F.col(f"__{k}_m")
        for c in keys[:k]:
            on &= F.col(f"__{n}_{c}").eqNullSafe(F.col(f"__{k}_{c}"))
        out = out.join(level, on)
    pick = lambda q: F.coalesce(*[F.when(F.col(f"__{k}total") >= min_group, F.col(f"__{k}{q}")) for k in range(n, 0, -1)], F.col(f"__0{q}"))
    least = F.create_map(*[F.lit(x) for m, (_, s, _) in MEASURES.items() for x in (m, s)])
    spread = F.greatest(pick("q75") - pick("q25"), F.element_at(least, F.col(f"__{n}_m")).cast("long"))
    rows = out.select(*[F.col(f"__{n}_{c}") for c in keys], F.col(f"__{n}_m").alias("m"), (pick("q25") - fence * spread).alias("lo"), (pick("q75") + fence * spread).alias("hi"))
    aggs = [F.max(F.when(F.col("m") == m, F.col(s))).alias(f"__{m}_{s}") for m in MEASURES for s in ("lo", "hi")]
    return rows.groupBy(*[f"__{n}_{c}" for c in keys]).agg(*aggs)


def quality_rules(
    docs: DataFrame, *, text_col: str = "text", keys: tuple[str, ...] = ("lang", "source"), carry_text: bool = True,
    min_words: int = 50, fence: int = FENCE, min_group: int = MIN_GROUP,
) -> DataFrame:
    """``docs`` with its measures, ``base_failed`` and ``kept``; without its text if ``carry_text`` is false."""
    made = (*MEASURED, "base_failed", "kept")
    numbers, (text, *keys), names = numbered(docs, made, text_col, *keys)
    rows = measured(numbers, text)
    rows = staged(rows if carry_text else rows.drop(text), "quality")
    valued = rows.withColumns({f"__v_{m}": F.expr(e) for m, (e, _, _) in MEASURES.items()})
    sketch = staged(sketches(valued.select(*keys, *[F.col(f"__v_{m}").alias(m) for m in MEASURES]), keys, list(MEASURES)), "sketch")
    limits = fences(sketch, keys, fence, min_group)
    on = F.lit(True)
    for c in keys:
        on &= F.col(c).eqNullSafe(F.col(f"__{len(keys)}_{c}"))
    inside = F.lit(True)
    for m, (_, _, lower) in MEASURES.items():
        inside &= F.col(f"__v_{m}") <= F.col(f"__{m}_hi")
        if lower:
            inside &= F.col(f"__v_{m}") >= F.col(f"__{m}_lo")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    carried = [c for c in names if c in rows.columns]
    out = valued.join(limits, on, "left").select(*carried, *MEASURED, failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(True))).alias("kept"))
    return out.toDF(*[names[c] for c in carried], *made)


def digest(rules: DataFrame) -> DataFrame:
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_VALUES = ", ".join(f"{e.replace(' div ', ' // ')} AS {m}" for m, (e, _, _) in MEASURES.items())


def _level(name: str, keys: str) -> str:
    by = f"{keys}, " if keys else ""
    return f"""{name}_s AS (SELECT {by}measure, bucket, sum(n) AS n FROM sketch GROUP BY ALL),
{name}_r AS (SELECT *, sum(n) OVER (PARTITION BY {by}measure) AS total, sum(n) OVER (PARTITION BY {by}measure ORDER BY bucket) AS cum,
  (bucket % 64)::BIGINT << (bucket // 64)::INT AS low FROM {name}_s),
{name} AS (SELECT {by}measure, max(total) AS total, min(low) FILTER (cum * 100 >= total * 25) AS q25, min(low) FILTER (cum * 100 >= total * 75) AS q75
  FROM {name}_r GROUP BY ALL)"""


ORACLE = rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c >= 2),
cov AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS d FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(ln.n - ln.d, 0)::BIGINT AS n_dup_lines,
  coalesce(cov.r, 0)::BIGINT AS n_repeat_words, coalesce(ln.n, 0)::BIGINT AS n_lines
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN ln USING (doc_id)),
v AS (SELECT *, {_VALUES} FROM m),
long AS (SELECT lang, source, measure, v FROM (SELECT lang, source, unnest(['{"', '".join(MEASURES)}']) AS measure, unnest([{", ".join(MEASURES)}]) AS v FROM v)),
b AS (SELECT lang, source, measure, greatest(length(bin(v)) - 6, 0)::INT AS sh, v FROM long),
sketch AS (SELECT lang, source, measure, sh * 64 + (v >> sh) AS bucket, count(*) AS n FROM b GROUP BY ALL),
{_level("l2", "lang, source")},
{_level("l1", "lang")},
{_level("l0", "")},
f AS (SELECT l2.lang, l2.source, l2.measure,
  CASE WHEN l2.total >= {MIN_GROUP} THEN l2.q25 WHEN l1.total >= {MIN_GROUP} THEN l1.q25 ELSE l0.q25 END AS q25,
  CASE WHEN l2.total >= {MIN_GROUP} THEN l2.q75 WHEN l1.total >= {MIN_GROUP} THEN l1.q75 ELSE l0.q75 END AS q75
  FROM l2 JOIN l1 ON l1.measure = l2.measure AND l1.lang IS NOT DISTINCT FROM l2.lang JOIN l0 ON l0.measure = l2.measure),
s AS (SELECT *, greatest(q75 - q25, CASE measure {" ".join(f"WHEN '{m}' THEN {x}" for m, (_, x, _) in MEASURES.items())} END) AS spread FROM f),
x AS (SELECT lang, source, {", ".join(f"max(q75 + {FENCE} * spread) FILTER (measure = '{m}') AS {m}_hi, max(q25 - {FENCE} * spread) FILTER (measure = '{m}') AS {m}_lo" for m in MEASURES)}
  FROM s GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {" AND ".join(f"{m} <= {m}_hi" + (f" AND {m} >= {m}_lo" if lo else "") for m, (_, _, lo) in MEASURES.items())} AS kept
FROM v JOIN x ON x.lang IS NOT DISTINCT FROM v.lang AND x.source IS NOT DISTINCT FROM v.source
"""
