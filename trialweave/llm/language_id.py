"""Language identification by Bayesian fusion of a text's likelihood with evidence from where it comes from.

For each language the log posterior of a row is the sum of
the likelihood of its byte trigrams (multinomial, smoothed, over whole texts, tempered because neighbouring trigrams depend on each other),
the likelihood of the declared markup language and of the address suffix given the language, and the prior of its host.

The likelihoods of declarations and suffixes and the priors are estimated over all rows by grouped sums of the posteriors from the text alone.
Priors are smoothed hierarchically: a host towards its site (the last two labels), a site towards its kind of source, that towards everything; a row's own share is left out.
The sums are pre-aggregated, one row a group; groups meet rows by joins on narrow rows (no texts) that Spark can broadcast or split.

The trigram table is fitted to ``max_train`` labelled texts, those of smallest hash (a documented bound).

Defined cases: an empty or null text has no likelihood and gets its language from the other evidence; texts and pages of any length are read whole; missing declarations,
suffixes and hosts add nothing; repeated rows each count; languages of equal posterior (a tie) are decided by the alphabet; null ids are rows as any other, ids may be of any type; without labelled texts the language
is null; an empty table gives an empty result; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm.html_text import host, page_text
from trialweave.llm.text import numbered
from trialweave.llm.words import blocks
from trialweave.plans.staging import staged

SLOTS = 1 << 16
MAX_TRAIN = 4000
#: Neighbouring trigrams share two bytes of three.
TEMPER = 1 / 3
#: Weight of the level above in a prior, in rows.
PULL = 10.0
SMOOTH = 0.5
#: Languages of country suffixes; a fixed list.
COUNTRY = {"de": "de", "at": "de", "li": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "pe": "es", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "it": "it", "nl": "nl", "pt": "pt", "br": "pt", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "kr": "ko", "se": "sv", "dk": "da", "fi": "fi", "gr": "el", "tr": "tr", "cz": "cs"}
_DECLARES = re.compile(r"<(html|meta)\b", re.I)
_LANG, _CONTENT = (re.compile(rf"\b{name}\s*=\s*[\"']?\s*([A-Za-z]{{2,3}})", re.I) for name in ("lang", "content"))
_NAMED = re.compile("content-language", re.I)


def declared_language(source: str | None) -> str | None:
    """The language that the first tag with one declares; each tag is read once, up to its end."""
    at = 0
    while source and (tag := _DECLARES.search(source, at)):
        at = source.find(">", tag.end())
        at = len(source) if at < 0 else at
        inside = source[tag.end() : at]
        if tag[1].lower() == "html":
            found = _LANG.search(inside)
        else:
            named = _NAMED.search(inside)
            found = _CONTENT.search(inside, named.end()) if named else None
        if found:
            return found[1].lower()
    return None


def _slots(buf: np.ndarray) -> np.ndarray:
    b = buf.astype(np.uint32)
    h = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(16)).astype(np.int32)


def _grams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, trigram slots, edges of rows) of runs of rows."""
    for lo, hi, buf, offs in blocks(texts):
        n = np.maximum(np.diff(offs) - 2, 0)
        slots = _slots(buf) if len(buf) > 2 else np.zeros(0, np.int32)
        edge = np.cumsum(n) - n
        yield lo, hi, slots[np.arange(int(n.sum())) + np.repeat(offs[:-1] - edge, n)], np.append(edge, n.sum())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for b in batches:
        langs = b.column(0).to_pylist()
        for lo, hi, slots, edge in _grams(b.column(1)):
            for i in range(lo, hi):
                part = slots[edge[i - lo] : edge[i - lo + 1]]
                held.setdefault(langs[i], np.zeros(SLOTS, np.int64))
                held[langs[i]] += np.bincount(part, minlength=SLOTS)
    for lang, n in held.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])], names=["lang", "slot", "n"])


def trained(labelled: DataFrame, text_col: str, lang_col: str, order: Column, max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (slots x languages) of trigrams, from ``max_train`` rows at most."""
    known = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).withColumn("__order", F.xxhash64(order))
    bound = known.select("__order").orderBy("__order").limit(max_train).agg(F.max("__order")).first()[0]
    if bound is None:
        return [], np.zeros((SLOTS, 0))
    rows = known.filter(F.col("__order") <= bound).select(lang_col, text_col).mapInArrow(_counts, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    table = np.full((SLOTS, len(langs)), SMOOTH)
    at = {x: i for i, x in enumerate(langs)}
    np.add.at(table, (rows.column("slot").to_numpy(), [at[x] for x in rows.column("lang").to_pylist()]), rows.column("n").to_numpy())
    return langs, np.log(table / table.sum(axis=0))


def _likelihoods(model, from_html: bool):
    """id, url, text or html, declared -> id, url, declared, log likelihoods by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for b in batches:
            texts, declared = b.column(2), b.column(3)
            if from_html:
                sources = texts.to_pylist()
                declared = pa.array([declared_language(s) for s in sources], pa.string())
                texts = pa.array([page_text(s) for s in sources], pa.large_string())
            out = np.zeros((b.num_rows, table.shape[1]))
            for lo, hi, slots, edge in _grams(texts):
                some = np.flatnonzero(np.diff(edge))
                for k in range(table.shape[1]):
                    if len(some):
                        out[lo + some, k] = np.add.reduceat(table[slots, k], edge[:-1][some])
            out -= out.max(axis=1, keepdims=True, initial=-np.inf) if table.shape[1] else 0
            out *= TEMPER
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), declared, pa.array(out.tolist(), pa.list_(pa.float64()))], names=["id", "url", "declared", "ll"])

    return run


def suffix(url: Column) -> Column:
    """A language code that leads the path or the host, else the language of the country of the host."""
    h = host(url)
    lead = F.lower(F.regexp_extract(url, r"//[^/]+/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:/|$)", 1))
    sub = F.regexp_extract(h, r"^([a-z]{2})\.", 1)
    country = F.create_map(*[F.lit(x) for kv in COUNTRY.items() for x in kv])
    return F.coalesce(F.when(lead != "", lead), F.when(sub != "", sub), F.try_element_at(country, F.regexp_extract(h, r"\.([a-z]{2})$", 1)))


def likelihoods(rows: DataFrame, langs: list[str], table: np.ndarray, *, id_col: str, text_col: str, url: Column, declared: Column, from_html: bool) -> DataFrame:
    model = rows.sparkSession.sparkContext.broadcast(table)
    slim = rows.select(F.col(id_col).alias("id"), url.cast("string").alias("url"), F.col(text_col).cast("string").alias("text"), declared.cast("string").alias("declared"))
    return slim.mapInArrow(_likelihoods(model, from_html), f"id {rows.schema[id_col].dataType.simpleString()}, url string, declared string, ll array<double>")


def fused(evidence: DataFrame, langs: list[str]) -> DataFrame:
    """Rows of (kind, host, declared, suffix, ll array<double>, others) with ``language`` and ``confidence``.

    ``ll`` holds the log likelihood of each of ``langs``.
    """
    k = len(langs)
    if not k:
        return evidence.select("*", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("confidence"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    norm = lambda xs: F.transform(F.array(xs), lambda a: F.transform(a, lambda x: F.exp(x - F.array_max(a))))[0]
    base = staged(evidence.withColumn("e", norm(F.col("ll"))).withColumn("p", F.transform("e", lambda x: x / total(F.col("e")))).drop("e").withColumn("site", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)), "evidence")
    sums = [F.sum(F.get("p", F.lit(i))).alias(f"s{i}") for i in range(k)]
    every = F.array(*[f"s{i}" for i in range(k)])
    group = lambda keys, name: base.groupBy(*keys).agg(*sums).select(*[F.col(c).alias(f"{name}_{c}") for c in keys], every.alias(name))
    whole = base.agg(*sums).first()
    out = base.withColumn("g0", F.array(*[F.lit(float(whole[f"s{i}"] or 0.0)) for i in range(k)]))
    for name, keys in {"g1": ["kind"], "g2": ["kind", "site"], "g3": ["kind", "host"]}.items():
        on = F.lit(True)
        for c in keys:
            on &= F.col(c).eqNullSafe(F.col(f"{name}_{c}"))
        out = out.join(group(keys, name), on, "left").drop(*[f"{name}_{c}" for c in keys])
    for name in ("declared", "suffix"):
        g = group([name], f"e_{name}")
        out = out.join(g.filter(F.col(f"e_{name}_{name}").isNotNull()), F.col(name) == F.col(f"e_{name}_{name}"), "left").drop(f"e_{name}_{name}")
    # A prior: the level's sums without the row's own share, pulled towards the level above.
    prior = F.transform(F.zip_with("g0", "p", lambda s, p: F.greatest(s - p, F.lit(0.0)) + SMOOTH), lambda x: x)
    prior = F.transform(F.array(prior), lambda a: F.transform(a, lambda x: x / total(a)))[0]
    for name in ("g1", "g2", "g3"):
        rest = F.zip_with(name, "p", lambda s, p: F.greatest(s - p, F.lit(0.0)))
        prior = F.transform(F.array(F.struct(rest.alias("r"), prior.alias("q"))), lambda a: F.zip_with(a["r"], a["q"], lambda r, q: (r + PULL * q) / (total(a["r"]) + PULL)))[0]
    out = out.withColumn("prior", prior)
    # P(value | language) up to a factor of the value: its share of the language's rows, over its share of all rows.
    alike = lambda name: F.when(F.col(name).isNull(), F.array_repeat(F.lit(0.0), k)).otherwise(
        F.zip_with(F.zip_with(name, "p", lambda s, p: F.greatest(s - p, F.lit(0.0)) + SMOOTH), "g0", lambda s, g: F.log(s / (g + 1.0)))
    )
    post = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get("ll", i) + F.log(F.get("prior", i)) + F.get("a", i) + F.get("b", i))
    out = out.withColumns({"a": alike("e_declared"), "b": alike("e_suffix")}).withColumn("post", norm(post))
    names = F.array(*[F.lit(x) for x in langs])
    best = F.array_position("post", F.array_max("post")).cast("int")
    return out.select(*evidence.columns, F.get(names, best - 1).alias("language"), (F.array_max("post") / total(F.col("post"))).alias("confidence"))


def identify(docs: DataFrame, pages: DataFrame, *, max_train: int = MAX_TRAIN) -> DataFrame:
    """Languages of all documents (their source is the host, nothing is declared) and of all pages: doc_id, page_id, language, confidence."""
    rows, at, _ = numbered(docs, (), "doc_id", "text", "lang", "source")
    docs = rows.select(*[F.col(c).alias(n) for c, n in zip(at, ("doc_id", "text", "lang", "source"), strict=True)])
    rows, at, _ = numbered(pages, (), "page_id", "url", "html")
    pages = rows.select(*[F.col(c).alias(n) for c, n in zip(at, ("page_id", "url", "html"), strict=True)])
    langs, table = trained(docs, "text", "lang", F.col("doc_id"), max_train)
    null = F.lit(None).cast("string")
    doc_null, page_null = (F.lit(None).cast(t.schema[c].dataType) for t, c in ((docs, "doc_id"), (pages, "page_id")))
    d = likelihoods(docs, langs, table, id_col="doc_id", text_col="text", url=F.col("source"), declared=null, from_html=False)
    p = likelihoods(pages, langs, table, id_col="page_id", text_col="html", url=F.col("url"), declared=null, from_html=True)
    d = d.select(F.lit("document").alias("kind"), F.col("id").alias("doc_id"), page_null.alias("page_id"), F.coalesce("url", F.lit("")).alias("host"), "declared", null.alias("suffix"), "ll")
    p = p.select(F.lit("page").alias("kind"), doc_null.alias("doc_id"), F.col("id").alias("page_id"), host(F.col("url")).alias("host"), "declared", suffix(F.col("url")).alias("suffix"), "ll")
    return fused(d.unionByName(p), langs).select("kind", "doc_id", "page_id", "language", "confidence", "declared", "suffix")
