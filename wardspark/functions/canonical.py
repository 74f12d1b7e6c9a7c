"""Canonical JSON of any depth: keys in order, no white space, and the checksum of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _quoted(text: Column) -> Column:
    # A string alone has no JSON in Spark; as the one field of a struct it has.
    inner = F.to_json(F.struct(text.alias("s")))
    return F.substring(inner, F.lit(6), F.length(inner) - 6)


def _number(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        shown = F.when(whole, F.when(value == 0, "0").otherwise(value.cast("decimal(20,0)").cast("string"))).otherwise(F.to_json(F.struct(value.alias("s"))).substr(F.lit(6), F.length(F.to_json(F.struct(value.alias("s")))) - 6))
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), "null").otherwise(shown)
    if isinstance(kind, T.DecimalType):
        return F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return value.cast("string")


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """The JSON of a column of type ``kind`` with the keys of structs and maps sorted at every depth.

    Keys are in the order of their UTF-8 bytes. Nulls are written, also in place of whole structs; whole doubles have no fraction, and what JSON can't say
    (NaN, infinities) is null. Times are strings as Spark writes them.
    """
    if isinstance(kind, T.StructType):
        parts = [x for i, f in enumerate(sorted(kind.fields, key=lambda f: f.name.encode())) for x in (*([F.lit(",")] if i else []), _quoted(F.lit(f.name)), F.lit(":"), canonical_json(value[f.name], f.dataType))]
        out = F.concat(F.lit("{"), *parts, F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_keys(value), lambda k: k.cast("string")))
        pair = lambda k: F.concat(_quoted(k), F.lit(":"), canonical_json(F.element_at(value, k.cast(kind.keyType)), kind.valueType))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, pair), ","), F.lit("}"))
    elif isinstance(kind, T.StringType):
        out = _quoted(value)
    elif isinstance(kind, T.BooleanType):
        out = F.when(value, "true").otherwise("false")
    elif isinstance(kind, T.NumericType):
        out = _number(value, kind)
    else:
        out = _quoted(value.cast("string"))
    return F.when(value.isNull(), "null").otherwise(out)


def checksum(value: Column, kind: T.DataType) -> Column:
    return F.sha2(canonical_json(value, kind), 256)
