"""Column functions on texts: trimming, matches with code-point offsets, masking, word tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,text:string>>"


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which value is worked out once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def spans(text: Column, pattern: str | Column) -> Column:
    """All matches of a pattern, in order, with half-open code-point offsets; null text has none.

    The pieces between the matches give the offsets, so they count code points, not UTF-16 units.
    """
    pattern = F.lit(pattern)
    pairs = held(F.regexp_extract_all(text, pattern, F.lit(0)), lambda hits: F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit")))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("text"))
        return F.struct(end.alias("at"), F.concat(done["found"], F.array(one)).alias("found"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))
    found = F.aggregate(pairs, zero, step, lambda x: x["found"])
    return F.when(F.regexp_like(text, pattern), found).otherwise(F.array().cast(SPANS))


def masked(text: Column, found: Column) -> Column:
    """text with every span of found (start, end) starred, right to left; overlapping spans are starred once each."""
    order = F.reverse(F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))))
    stars = lambda t, x: F.concat(F.substring(t, F.lit(1), x["start"]), F.repeat(F.lit("*"), x["end"] - x["start"]), F.substring(t, x["end"] + 1, F.length(t)))
    return F.aggregate(order, text, stars)


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def joined_in_order(order: Column, text: Column, separator: str = "\n") -> Column:
    """Aggregate: texts of a group in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), separator)
