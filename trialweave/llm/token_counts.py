"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A change is a row (op, source, lang, tokenizer, n_tokens, old_tokens): an ``insert`` adds one document and its tokens, a ``delete`` takes them away, a
``revise`` adds the difference to the old count.  A batch of changes is summed by key before it is written, so it is as small as its keys.
Totals are sums over the committed batches: additive, in any order.

A commit is one rename of a written folder to ``batch=<name>``.  A batch whose folder is there has been committed and is skipped, so a repeated
or restarted commit changes nothing; what a lost job left behind isn't under such a name and is never read.  :meth:`Rollup.compact` folds batches into
one, which keeps their names.

Defined cases: null keys are keys of their own; null counts are 0; an unknown op is an error; empty batches commit as empty, an empty table has no totals;
a total whose documents and tokens are both 0 isn't shown; a null or empty text is a document of no tokens; texts of any length are counted whole.
In the replay the copy with the smallest id stays; a null id is no copy of anything and rows of one id (ties) aren't copies of each other, so neither is deleted.
:func:`counted` keeps other columns and replaces those named as a tokenizer, in any case of letters.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.llm.bpe import Vocabulary
from trialweave.llm.text import numbered, words_counted
from trialweave.plans.staging import shared_dir, staged

KEYS = ("source", "lang", "tokenizer")
CHANGES = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"
_TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of a batch by key."""
    new, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    op = F.col("op")
    wrong = F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(op, F.lit("null"))))
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(wrong.cast("int"))
    tokens = F.when(op == "insert", new).when(op == "delete", -new).otherwise(new - old)
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))


class Rollup:
    """A folder of committed batches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    @staticmethod
    def _name(batch: str) -> str:
        return "batch=" + base64.urlsafe_b64encode(batch.encode()).decode().rstrip("=")

    def _names(self, base: str) -> set[str]:
        """The batches in a base."""
        return {r["name"] for r in self.spark.read.parquet(f"{self.path}/{base}/names").collect()}

    def _folders(self) -> list[str]:
        if not self._fs.exists(self._at("")):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("")) if s.getPath().getName().startswith(("batch=", "base=")))

    def committed(self, live: list[str] | None = None) -> set[str]:
        """Names of all batches, those in a base too."""
        live = self._live() if live is None else live
        return {f for f in live if f.startswith("batch=")}.union(*[self._names(f) for f in live if f.startswith("base=")])

    def _live(self) -> list[str]:
        """The newest base, and the batches that aren't in it."""
        folders = self._folders()
        bases = sorted((f for f in folders if f.startswith("base=")), key=lambda f: int(f[5:]))
        batches = [f for f in folders if f.startswith("batch=")]
        if not bases:
            return batches
        names = self._names(bases[-1])
        return [bases[-1], *[b for b in batches if b not in names]]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False if it has been committed before."""
        name = self._name(batch)
        if name in self.committed():
            return False
        draft = f"_draft-{name}-{uuid.uuid4().hex}"  # two writers of one batch don't share it
        deltas(changes).write.mode("overwrite").parquet(f"{self.path}/{draft}")
        if self._fs.exists(self._at(name)) or not self._fs.rename(self._at(draft), self._at(name)):
            self._fs.delete(self._at(draft), True)
            if name in self.committed():
                return False  # another writer was first
            raise OSError(f"batch {batch} couldn't be committed")
        return True

    def compact(self) -> None:
        """One folder for all that is committed: totals and names are of one listing, so a batch that comes in meanwhile stays a batch."""
        live, folders = self._live(), self._folders()
        number = 1 + max((int(f[5:]) for f in folders if f.startswith("base=")), default=0)
        draft = f"_draft-base-{number}-{uuid.uuid4().hex}"
        self._sum(live).write.mode("overwrite").parquet(f"{self.path}/{draft}/totals")
        names = sorted(self.committed(live))
        self.spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{draft}/names")
        if self._fs.exists(self._at(f"base={number}")) or not self._fs.rename(self._at(draft), self._at(f"base={number}")):
            self._fs.delete(self._at(draft), True)
            raise OSError("the base couldn't be committed")
        for f in live:
            self._fs.delete(self._at(f), True)

    def _sum(self, live: list[str]) -> DataFrame:
        paths = [f"{self.path}/{f}" + "/totals" * f.startswith("base=") for f in live]
        if not paths:
            return self.spark.createDataFrame([], _TOTALS)
        rows = self.spark.read.schema(_TOTALS).parquet(*paths)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens."""
        return self._sum(self._live()).filter("n_docs <> 0 or n_tokens <> 0")


def _counter(vocabularies):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [v.count for v in vocabularies.value]
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(b.num_columns - 1)]
            counts = [pa.array([count(t) for t in texts], pa.int64()) for count in counters]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *counts], names=[*b.schema.names[:-1], *[f"n{i}" for i in range(len(counts))]])

    return run


def counted(docs: DataFrame, vocabularies: dict[str, Vocabulary], text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with a count of tokens in a column for each tokenizer version."""
    named, (text,), names = numbered(docs, vocabularies, text_col)
    rest = [c for c in names if c != text]
    shared = docs.sparkSession.sparkContext.broadcast(list(vocabularies.values()))
    fields = "".join(f"{c} {named.schema[c].dataType.simpleString()}, " for c in rest)
    out = named.select(*rest, F.col(text).cast("string").alias("t")).mapInArrow(_counter(shared), fields + ", ".join(f"n{i} long" for i in range(len(vocabularies))))
    return out.toDF(*[names[c] for c in rest], *vocabularies)


def replayed(docs: DataFrame, vocabularies: dict[str, Vocabulary], path: str | None = None, *, restore: bool = False) -> DataFrame:
    """The life of a corpus as batches: all texts are inserted with a count of words as a first estimate, the estimate is revised by the tokenizer's count (twice:
    the second commit is a repetition), later versions are inserted, copies of a text are deleted; with ``restore`` they are inserted again, so the totals
    are of all rows.  Returns the totals."""
    spark = docs.sparkSession
    rollup = Rollup(spark, path or f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    named, (doc, source, lang, column), _ = numbered(docs, (), "doc_id", "source", "lang", "text")
    text = F.col(column)
    slim = named.select(F.col(doc).alias("doc_id"), F.col(source).alias("source"), F.col(lang).alias("lang"), words_counted(text).alias("estimate"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("copy"), text).alias("h2"), text.alias("text"))
    rows = staged(counted(slim, vocabularies), "counts")
    first, *later = vocabularies
    change = lambda op, version, new, old=None: rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer"), F.col(new).alias("n_tokens"), (F.col(old) if old else F.lit(None).cast("long")).alias("old_tokens"))
    rollup.commit("load", change("insert", first, "estimate"))
    for _ in range(2):
        rollup.commit("revision", change("revise", first, first, "estimate"))
    for v in later:
        rollup.commit(f"insert {v}", change("insert", v, v))
    rollup.compact()
    keep = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("kept"))
    copies = rows.join(keep, ["h1", "h2"]).filter(F.col("doc_id") > F.col("kept"))
    gone = copies.select("source", "lang", F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.col(v).alias("n_tokens")) for v in vocabularies])).alias("x"))
    again = lambda op: gone.select(F.lit(op).alias("op"), "source", "lang", "x.tokenizer", "x.n_tokens", F.lit(None).cast("long").alias("old_tokens"))
    rollup.commit("copies", again("delete"))
    if restore:
        rollup.commit("copies restored", again("insert"))
    rollup.commit("load", change("insert", first, "estimate"))
    return rollup.totals()
