"""Spans of regular-expression matches in whole texts, as Column expressions.

A span is ``struct(start, ord, end, kind, text)`` in code points, end exclusive. Spark gives the
matched strings of a pattern and, by ``split``, what lies between them; running sums over
their lengths give the places. Both walk the text as Java's matcher does, leftmost and
without overlaps. Texts without a match, most of them, cost one search.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,ord:int,end:int,kind:string,text:string>"


def find(text: Column, pattern: str, kind: str, order: int, valid: Callable[[Column], Column] | None = None) -> Column:
    """All spans of ``pattern``; those whose text fails ``valid`` are dropped after matching."""
    p = F.lit(pattern)
    matches = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast(f"array<{SPAN}>")

    def add(acc: Column, pair: Column) -> Column:
        start = acc["pos"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), pair["match"].alias("text"))
        more = F.concat(acc["spans"], F.array(span))
        return F.struct(end.alias("pos"), (more if valid is None else F.when(valid(pair["match"]), more).otherwise(acc["spans"])).alias("spans"))

    # gaps has one entry more than matches
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    start = F.struct(F.lit(0).alias("pos"), empty.alias("spans"))
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, add, lambda acc: acc["spans"])).otherwise(empty)


def merged(groups: Sequence[Column]) -> Column:
    """The spans of several kinds by start, then by kind as listed."""
    return F.array_sort(F.concat(*groups))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def cut_out(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """``text`` with each span replaced; of overlapping spans the first one holds."""
    pieces = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["pos"],
            F.struct(s["end"].alias("pos"), F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), replacement(s)).alias("out")),
        ).otherwise(acc),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(pieces["out"], F.substring(text, pieces["pos"] + 1, F.length(text))))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check; every second digit from the right is doubled."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, F.try_to_number(c, F.lit("9")).cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.try_to_number(c, F.lit("9")).cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0
