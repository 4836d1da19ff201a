"""Spans of patterns in whole texts, by DataFrame functions alone.

A pattern's matches are put between marks and the text is cut at the marks, so every
other piece is a match and its place is the sum of the lengths before it.  The mark is a
private-use character; where a text has it, another character that no pattern accepts takes
its place first, which moves nothing.  All offsets are code points, ends exclusive.

Patterns have to be linear on hostile texts: runs are possessive, and a pattern that begins
with a run must not begin inside one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, INSTEAD = "\ue000", "\ufffd"
#: Code points on either side of a match that are kept with it.
CONTEXT = 48
_BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """A name, a Java pattern, and a condition that a match (a string column) has to meet."""

    name: str
    pattern: str
    holds: Callable[[Column], Column] | None = None


def clean(text: Column) -> Column:
    """The text that is searched: as long as the given one, never null, without marks."""
    return F.translate(F.coalesce(text, F.lit("")), MARK, INSTEAD)


def pieces_of(text: Column, pattern: str) -> Column:
    """Gap, match, gap, ... of a clean text; null where nothing matches."""
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
    return F.when(text.rlike(pattern), F.split(marked, MARK, -1))


def running_sums(values: Column) -> Column:
    """The sum before each of an array of bigint, in blocks so that long arrays stay cheap."""
    zero = F.lit(0).cast("bigint")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))
    add = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: acc + x))
    bases = F.aggregate(totals, F.array(zero), add)
    return F.flatten(F.transform(blocks, lambda b, i: F.slice(F.aggregate(b, F.array(F.element_at(bases, i + 1)), add), F.lit(1), F.size(b))))


SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,value:string,before:string,after:string>"


def _spans_of(kind: Kind, rank: int, pieces: str, lengths: str, starts: str) -> Column:
    def span(i: Column) -> Column:
        return F.struct(
            F.element_at(starts, i).alias("start"),
            F.lit(rank).alias("rank"),
            (F.element_at(starts, i) + F.element_at(lengths, i)).alias("end"),
            F.lit(kind.name).alias("kind"),
            F.element_at(pieces, i).alias("value"),
            F.right(F.element_at(pieces, i - 1), F.lit(CONTEXT)).alias("before"),
            F.left(F.element_at(pieces, i + 1), F.lit(CONTEXT)).alias("after"),
        )

    found = F.transform(F.sequence(F.lit(2), F.size(pieces) - 1, F.lit(2)), span)
    return F.filter(found, lambda x: kind.holds(x["value"])) if kind.holds else found


def with_spans(rows: DataFrame, text: str, kinds: list[Kind], prefix: str) -> DataFrame:
    """Adds, per kind, an array of its spans: column prefix + kind name; `text` has to be clean."""
    for rank, kind in enumerate(kinds):
        p, n, s = f"{prefix}p", f"{prefix}n", f"{prefix}s"
        rows = rows.withColumn(p, pieces_of(F.col(text), kind.pattern))
        rows = rows.withColumn(n, F.when(F.col(p).isNotNull(), F.transform(p, lambda x: F.char_length(x).cast("bigint"))))
        rows = rows.withColumn(s, F.when(F.col(p).isNotNull(), running_sums(F.col(n))))
        found = _spans_of(kind, rank, p, n, s)
        rows = rows.withColumn(prefix + kind.name, F.coalesce(F.when(F.col(p).isNotNull(), found), F.array().cast(f"array<{SPAN}>"))).drop(p, n, s)
    return rows


def together(columns: list[str]) -> Column:
    """Arrays of spans as one, by start and then rank."""
    return F.array_sort(F.flatten(F.array(*columns)))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
