"""Spelling variants: words at distance one, found by a symmetric-delete join and followed to their most frequent form.

Words are counted once, numbered by falling count and then code points, and every word emits a key for itself and one for each single deletion, with its number only.  A key is a
124-bit checksum of the letters, which prefix and suffix sums give for all deletions of a word at once: a word of n letters costs n rows, not n times n letters.

Words that share a deletion *at the same place* differ by that one letter, so such a group is a clique: each of its words is near all others and the lowest number is the best form for all but itself, which takes the second.
Such groups are no larger than the alphabet.  A word that equals a deletion of another one is near it; each pair is met under one key.  So near words are counted in as many rows as
there are deletions, without pairs within a group.  What the keys say is verified on the letters before it counts.

Forms have several times the count of their variants, so following them ends after as many steps as the logarithm of the largest count; links are doubled each round.

Defined cases: null and empty texts have no words; a run of any length is one word; of forms of equal count the first in code-point order is taken; rows with a null id lose no letters in
:func:`misspelt`, repeated rows count again; an empty table gives an empty result; columns beside id and text aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialweave.llm.text import ascii_lower, numbered, whole
from trialweave.plans.staging import staged

RUN = r"[A-Za-zÀ-ÿ]+"
LETTERS, OCCURRENCES, TIMES = 6, 5, 5
#: So many letters are worked through together, or one longer word.
TOGETHER = 1 << 20
#: Four primes below 2 ** 31, and a base for each.
_PRIMES = tuple(np.uint64(p) for p in (2147483647, 2147483629, 2147483587, 2147483579))
_BASES = (1103515245, 69069, 1664525, 22695477)


def words_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS) -> DataFrame:
    """id, word: a row for each run of letters of ``letters`` code points or more, A-Z lower-cased."""
    named, (doc, text), _ = numbered(docs, (), id_col, text_col)
    runs = named.select(F.col(doc).alias("id"), F.explode(F.regexp_extract_all(whole(F.col(text)), F.lit(RUN), F.lit(0))).alias("run"))
    return runs.filter(F.char_length("run") >= letters).select("id", ascii_lower(F.col("run")).alias("word"))


def misspelt(words: DataFrame, every: int = 199) -> DataFrame:
    """``words`` (id, word), one in ``every`` without one letter; which word and letter goes by the checksum of both: a known load of variants."""
    h = F.crc32(F.concat(F.col("id").cast("string"), F.lit(":"), F.col("word")).cast("binary"))
    at = (h % F.char_length("word")).cast("int")
    w = F.col("word")
    return words.select("id", F.when(h % every == 0, F.concat(F.substring(w, F.lit(1), at), F.substring(w, at + 2, F.char_length(w)))).otherwise(w).alias("word"))


def _powers(base: int, prime: np.uint64, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    step = np.uint64(base)
    while len(out) < n:
        out = np.concatenate((out, out * step % prime))
        step = step * step % prime
    return out[:n]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """number, word -> number, place (-1: the word itself), first (the deletion isn't that of the letter before), k1, k2."""

    def some(numbers: np.ndarray, words: list[str]) -> pa.RecordBatch:
        sizes = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        start = np.cumsum(sizes) - sizes
        place = np.arange(len(letters)) - np.repeat(start, sizes)
        word = np.repeat(np.arange(len(words)), sizes)
        first = np.ones(len(letters), bool)
        first[1:] = (letters[1:] != letters[:-1]) | (place[1:] == 0)
        cut, own = [], []
        for base, prime in zip(_BASES, _PRIMES, strict=True):
            power = _powers(base, prime, int(sizes.max()))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters.astype(np.uint64) * power[place] % prime, dtype=np.uint64)))
            before = (sums[:-1] - sums[start][word]) % prime
            after = (sums[start + sizes][word] - sums[1:]) % prime
            cut.append((before + after * np.uint64(pow(base, -1, int(prime)))) % prime)
            own.append((sums[start + sizes] - sums[start]) % prime)
        k1, k2 = (np.concatenate((cut[i], own[i])) << np.uint64(31) | np.concatenate((cut[i + 1], own[i + 1])) for i in (0, 2))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((numbers[word], numbers))), pa.array(np.concatenate((place, np.full(len(words), -1))).astype(np.int32)),
                pa.array(np.concatenate((first, np.zeros(len(words), bool)))), pa.array(k1.astype(np.int64)), pa.array(k2.astype(np.int64)),
            ],
            names=["number", "place", "first", "k1", "k2"],
        )

    for b in batches:
        numbers, words = b.column(0).to_numpy(), b.column(1).to_pylist()
        lo, size = 0, 0
        for k, w in enumerate(words):
            size += len(w)
            if size >= TOGETHER or k == len(words) - 1:
                yield some(numbers[lo : k + 1], words[lo : k + 1])
                lo, size = k + 1, 0


def _same_but(a: Column, b: Column, place: Column, skip: int) -> Column:
    """``a`` without its letter at ``place`` is ``b`` without ``skip`` letters there."""
    far = F.char_length(a)
    return (F.char_length(a) - 1 == F.char_length(b) - skip) & (F.substring(a, F.lit(1), place) == F.substring(b, F.lit(1), place)) & (F.substring(a, place + 2, far) == F.substring(b, place + 1 + skip, far))


def near_words(words: DataFrame) -> DataFrame:
    """``words`` (number, word), numbers unique -> number, n_near, best (the lowest number of a near word), for words that have one."""
    keyed = words.select("number", "word").mapInArrow(_keys, "number long, place int, first boolean, k1 long, k2 long").repartition("k1", "k2")
    key = Window.partitionBy("k1", "k2")
    clique = Window.partitionBy("k1", "k2", "place").orderBy("number")
    every = clique.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = (
        keyed.withColumn("g", F.count("*").over(every)).withColumn("hub", F.first("number").over(every)).withColumn("second", F.nth_value("number", 2).over(every))
        .withColumn("self", F.max(F.when(F.col("place") < 0, F.col("number"))).over(key))
        .filter("place >= 0 and (g > 1 or first and self is not null)")
    )
    met = staged(met, "met")
    other = F.when(F.col("hub") == F.col("number"), F.col("second")).otherwise(F.col("hub"))
    swapped = met.filter("g > 1").select("number", other.alias("other"), "place", F.lit(1).alias("skip"), (F.col("g") - 1).alias("n"))
    longer = met.filter("first and self is not null").select("number", F.col("self").alias("other"), "place", F.lit(0).alias("skip"), F.lit(1).cast("long").alias("n"))
    pairs = swapped.unionAll(longer)
    a, b = words.select("number", F.col("word").alias("a")), words.select(F.col("number").alias("other"), F.col("word").alias("b"))
    verified = pairs.join(a, "number").join(b, "other")
    right = F.when(F.col("skip") == 1, _same_but(F.col("a"), F.col("b"), F.col("place"), 1)).otherwise(_same_but(F.col("a"), F.col("b"), F.col("place"), 0))
    verified = verified.withColumn("sure", F.when(right, F.lit(True)).otherwise(F.raise_error(F.lit("two words have one checksum")).cast("boolean"))).filter("sure")
    both = verified.select("number", "other", "n", "skip").withColumn("way", F.explode(F.when(F.col("skip") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    ends = both.select(F.when(F.col("way") == 0, F.col("number")).otherwise(F.col("other")).alias("number"), F.when(F.col("way") == 0, F.col("other")).otherwise(F.col("number")).alias("other"), "n")
    return ends.groupBy("number").agg(F.sum("n").alias("n_near"), F.min("other").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """``links`` (number, up), without cycles, one of each number -> number, root."""
    now = staged(links.select("number", "up"), "links")
    while True:
        above = now.select(F.col("number").alias("up"), F.col("up").alias("next"))
        now = staged(now.join(above, "up", "left").select("number", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "links")
        if now.filter("moved").isEmpty():
            return now.select("number", F.col("up").alias("root"))
        now = now.select("number", "up")


def variants(words: DataFrame, *, letters: int = LETTERS, occurrences: int = OCCURRENCES, times: int = TIMES) -> DataFrame:
    """``words`` (word, a row an occurrence) -> word, form, root, n, n_near, form_n of words of so many letters and occurrences; a form has ``times`` the occurrences."""
    counted = staged(words.filter(F.char_length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= occurrences), "words")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = counted.repartitionByRange(parts, F.desc("n"), "word").sortWithinPartitions(F.desc("n"), "word")
    numbers = staged(ordered.select(F.monotonically_increasing_id().alias("number"), "word", "n"), "numbered")
    near = staged(near_words(numbers), "near")
    named = lambda a, b, c: numbers.select(F.col("number").alias(a), F.col("word").alias(b), F.col("n").alias(c))
    linked = numbers.join(near, "number", "left").join(named("best", "form", "form_n"), "best", "left")
    is_form = F.col("form_n") >= times * F.col("n")
    linked = staged(
        linked.select("number", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(is_form, F.col(c)).alias(c) for c in ("best", "form", "form_n")]), "forms"
    )
    tops = roots(linked.filter("best is not null").select("number", F.col("best").alias("up"))).join(named("root", "top", "top_n"), "root").select("number", "top")
    return linked.join(tops, "number", "left").select("word", "form", F.coalesce("top", "word").alias("root"), "n", "n_near", "form_n")
