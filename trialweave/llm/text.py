"""Column expressions that several text operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole(text: Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def ascii_lower(s: Column) -> Column:
    """A-Z lowered, every other character as it is; ``lower`` does that for pure ASCII and is faster."""
    return F.when(F.octet_length(s) == F.char_length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(SPACE))


def let(value: Column, body) -> Column:
    """``body(x)`` with x bound to ``value``, which is evaluated once a row and not once a use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_counted(text: Column) -> Column:
    """How many runs of other characters than white space a text has."""
    return F.size(F.filter(F.split(whole(text), SPACE_CLASS + "+"), lambda w: w != "")).cast("long")


def place(docs: DataFrame, name: str) -> int:
    """Where a column stands: the one of exactly that name, else the first that differs in upper and lower case only."""
    if name in docs.columns:
        return docs.columns.index(name)
    found = [k for k, c in enumerate(docs.columns) if c.lower() == name.lower()]
    if not found:
        raise ValueError(f"no column {name} among {', '.join(docs.columns)}")
    return found[0]


def numbered(docs: DataFrame, made: Iterable[str], *needed: str) -> tuple[DataFrame, list[str], dict[str, str]]:
    """``docs`` with columns named by place, so that no caller's name meets a working name; the names of ``needed`` there;
    and what the columns are called in the result, without those that bear the name of one ``made``, in whatever case of letters."""
    taken = {m.lower() for m in made}
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return rows, [f"c{place(docs, c)}" for c in needed], {f"c{k}": c for k, c in enumerate(docs.columns) if c.lower() not in taken}
