"""Offsets of matches, in code points, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,stop:int,value:string>>"


def _matched(text: Column, pattern: str, f, empty: Column) -> Column:
    """f of what lies between matches with the match that follows (the last has none), or ``empty`` without matches.

    The matches are bound first, as expressions in lambdas are evaluated wherever they are named: a text without any is searched once.
    """
    cut = lambda m: F.arrays_zip(F.split(text, pattern, -1).alias("b"), m.alias("m"))
    found = F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.get(F.transform(found, lambda m: F.when(F.size(m) == 0, empty).otherwise(f(cut(m)))), F.lit(0))


def spans(text: Column, pattern: str, where: Column | None = None) -> Column:
    """array<struct<start, stop, value>> of all matches: offsets add up from the lengths of what lies between them.

    Texts that ``where`` excludes have none and are not searched.
    """
    none = F.array().cast(SPANS)

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        stop = start + F.length(x["m"])
        out = F.array_append(acc["out"], F.struct(start.alias("start"), stop.alias("stop"), x["m"].alias("value")))
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(stop.alias("at"), out.alias("out")))

    first = F.struct(F.lit(0).alias("at"), none.alias("out"))
    found = _matched(text, pattern, lambda parts: F.aggregate(parts, first, add, lambda acc: acc["out"]), none)
    return found if where is None else F.when(where, found).otherwise(none)


def pieces(text: Column, pattern: str) -> Column:
    """The same of what lies between the matches."""

    def add(acc: Column, x: Column) -> Column:
        stop = acc["at"] + F.length(x["b"])
        piece = F.struct(acc["at"].alias("start"), stop.alias("stop"), x["b"].alias("value"))
        return F.struct((stop + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"), F.array_append(acc["out"], piece).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("stop"), text.alias("value"))).cast(SPANS)
    return _matched(text, pattern, lambda parts: F.aggregate(parts, first, add, lambda acc: acc["out"]), whole)
