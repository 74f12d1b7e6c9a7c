"""The fold of a conversation over its messages in order: each is scanned with the placeholders that earlier ones left.

What a fold would carry from message to message is a number for each type: the highest placeholder so
far. A message that adds k values, and whose text holds placeholders up to t, turns c into max(c, t) + k. Such steps
compose to max(c + a, b), so running sums and running maxima in windows give every message its number without
walking the conversation in one task's memory. Texts meet values of earlier messages by their first word.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import ENTITY_TYPES, PLACEHOLDER, ascii_lower, words
from ..functions.scan import risk_level, scan, scan_action, spliced, stable_key
from ..shared import kept
from .conversations import known_entities, without_overlaps

SPANS = "array<struct<start:int,stop:int,id:string,type:string>>"
KNOWN = "array<struct<id:string,type:string,original:string>>"


class Fold(NamedTuple):
    """messages: conv_id, turn, place, role, entities, redacted, flags, risk_score, action; vault: conv_id, placeholder, type, original."""

    messages: DataFrame
    vault: DataFrame


def ordered(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, place, role, text): places from 1 by turn, nulls first, then role, then text; null texts are empty.

    Places, not turns, tell messages apart, so rows that share a turn, or repeat another wholly, stay messages of their own.
    """
    rows = messages.select("conv_id", "turn", (F.col("role") if "role" in messages.columns else F.lit(None).cast("string")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))


def _number(placeholder: Column) -> Column:
    return F.regexp_extract(placeholder, PLACEHOLDER, 2).cast("long")


def _first_word(original: Column) -> Column:
    """A value stands between word boundaries, so its first run of word characters is a whole word of the text; '' if it has none."""
    return F.coalesce(F.get(F.filter(words(ascii_lower(original)), lambda w: w != ""), F.lit(0)), F.lit(""))


def _numbered(values: DataFrame, marks: DataFrame) -> DataFrame:
    """values (conv_id, place, type, key, start, original, saved, given) with the placeholder of each at its place.

    Rows of place 0 are seeds with a placeholder given. A value is known after a message that saved it.
    """
    same = Window.partitionBy("conv_id", "type", "key")
    first = F.min(F.when(F.col("saved"), F.col("place"))).over(same)
    values = values.withColumn("first", first).withColumn("new", F.col("place") <= F.coalesce("first", F.col("place")))
    counted = values.where("place > 0 and new").groupBy("conv_id", "type", "place").agg(F.count(F.lit(1)).alias("k"), F.first("saved").alias("saved"))
    seeds = values.where("place = 0").groupBy("conv_id", "type").agg(F.max(_number(F.col("given"))).alias("c"))
    steps = counted.join(marks, ["conv_id", "type", "place"], "left").withColumn("t", F.coalesce("t", F.lit(0)))
    before = Window.partitionBy("conv_id", "type").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("sum", F.coalesce(F.sum(F.when(F.col("saved"), F.col("k"))).over(before), F.lit(0)))
    steps = steps.withColumn("high", F.max(F.when(F.col("saved"), F.col("t") - F.col("sum"))).over(before)).join(seeds, ["conv_id", "type"], "left")
    so_far = F.col("sum") + F.greatest(F.coalesce("c", F.lit(0)), F.coalesce("high", F.lit(0)))
    steps = steps.select("conv_id", "type", "place", F.greatest(so_far, F.col("t")).alias("base"))
    own = Window.partitionBy("conv_id", "type", "place").orderBy("start")
    fresh = values.where("place > 0 and new").withColumn("nth", F.row_number().over(own)).join(steps, ["conv_id", "type", "place"])
    fresh = fresh.select(*values.columns, F.concat(F.lit("["), "type", F.lit("_"), (F.col("base") + F.col("nth")).cast("string"), F.lit("]")).alias("id"))
    rest = values.where("place = 0 or not new").select(*values.columns, F.col("given").alias("id"))
    saved = F.max(F.when(F.col("place") == F.col("first"), F.col("id"))).over(same)
    return fresh.unionByName(rest).withColumn("id", F.coalesce("id", saved))


def fold(messages: DataFrame, seeds: DataFrame | None = None, sensitivity: str = "Internal", persons: str | None = "hybrid") -> Fold:
    """Every message of (conv_id, turn, role, text) as it is sent on, and what each conversation's vault holds at the end.

    A value that the vault knows keeps its placeholder; others are numbered on after the highest of the vault and of
    the text. Known values that the scan misses are added where they overlap nothing, and raise the risk to
    40. Blocked messages leave nothing in the vault, and secrets are never left there. ``seeds`` (conv_id, placeholder,
    type, original) is a vault from before. Messages without a conv_id share one conversation of no id that is dropped.
    """
    placed = ordered(messages.where("conv_id is not null"))
    at = F.struct("conv_id", "turn", "place", "role", "text").alias("at")
    scanned = scan(placed.select(at, "text"), "at", sensitivity=sensitivity, persons=persons)
    scanned = kept(scanned.select("at.*", "entities", "flags", "risk_score", "action"), "scanned-messages")
    each = scanned.select("conv_id", "place", "action", F.explode_outer("entities").alias("e")).where("e is not null")
    key = stable_key(F.col("e.type"), F.col("e.original"))
    values = each.groupBy("conv_id", "place", F.col("e.type").alias("type"), key.alias("key")).agg(
        F.min(F.struct("e.start", "e.original")).alias("x"), F.max(F.struct("e.start", "e.original")).alias("y"), F.first("action").alias("action")
    )
    saved = (F.col("action") != "block") & (F.col("type") != "SECRET")
    # Of a value that a message writes in two ways the last is what the vault shows.
    values = values.select("conv_id", "place", "type", "key", F.col("x.start").alias("start"), F.col("y.original").alias("original"), saved.alias("saved"), F.lit(None).cast("string").alias("given"))
    if seeds is not None:
        old = seeds.where("type <> 'SECRET'").select("conv_id", F.lit(0).alias("place"), "type", stable_key(F.col("type"), F.col("original")).alias("key"), _number(F.col("placeholder")).cast("int").alias("start"), "original", F.lit(True).alias("saved"), F.col("placeholder").alias("given"))
        values = values.unionByName(old)
    texts = scanned.where(F.contains("text", F.lit("["))).select("conv_id", "place", F.explode(F.regexp_extract_all("text", F.lit(PLACEHOLDER), F.lit(0))).alias("p"))
    marks = texts.groupBy("conv_id", F.regexp_extract("p", PLACEHOLDER, 1).alias("type"), "place").agg(F.max(_number(F.col("p"))).alias("t"))
    named = kept(_numbered(values, marks), "numbered-values")

    # What the vault shows for a placeholder changes with each message that saves it; ``until`` is the last message that sees this form.
    forms = Window.partitionBy("conv_id", "id").orderBy("place")
    shown = named.where("saved").select("conv_id", "id", "type", "original", "place", "first", "start", F.lead("place").over(forms).alias("until"))
    shown = shown.where("original <> ''").withColumn("word", _first_word(F.col("original")))
    held = scanned.select("conv_id", F.col("place").alias("seen"), F.explode(F.array_distinct(F.concat(words(ascii_lower(F.col("text"))), F.array(F.lit(""))))).alias("word"))
    met = held.join(shown, ["conv_id", "word"]).where((F.col("place") < F.col("seen")) & (F.col("seen") <= F.coalesce("until", F.col("seen"))))
    entry = F.struct("first", "start", F.struct("id", "type", "original").alias("v"))
    met = met.groupBy("conv_id", F.col("seen").alias("place")).agg(F.transform(F.array_sort(F.collect_set(entry)), lambda x: x["v"]).alias("vault"))
    ids = named.where("place > 0").groupBy("conv_id", "place").agg(F.collect_list(F.struct("type", "key", "id")).alias("ids"))
    both = scanned.join(ids, ["conv_id", "place"], "left").join(met, ["conv_id", "place"], "left")

    mine = lambda e: F.get(F.filter("ids", lambda v: (v["type"] == e["type"]) & (v["key"] == stable_key(e["type"], e["original"]))), F.lit(0))["id"]
    own = F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), mine(e).alias("id"), e["type"].alias("type"))).cast(SPANS)
    known = known_entities(F.col("text"), F.coalesce("vault", F.array().cast(KNOWN))).cast(SPANS)
    out = both.select("*", own.alias("own"), known.alias("known")).select("*", without_overlaps(F.col("own"), F.col("known")).alias("all"))
    flag = F.create_map(*[F.lit(x) for t, v in ENTITY_TYPES.items() if v[2] for x in (t, v[2])])
    flags = F.array_distinct(F.concat("flags", F.filter(F.transform("known", lambda e: F.try_element_at(flag, e["type"])), lambda f: f.isNotNull())))
    risk = F.when(F.size("known") > 0, F.greatest("risk_score", F.lit(40))).otherwise(F.col("risk_score"))
    out = out.select(
        "conv_id", "turn", "place", "role", F.col("all").alias("entities"), spliced(F.col("text"), F.col("all"), F.transform("all", lambda e: e["id"])).alias("redacted"), flags.alias("flags"), risk.alias("risk_score"),
    ).withColumns({"risk_level": risk_level(F.col("risk_score")), "action": scan_action(F.col("flags"))})
    last = named.where("saved").groupBy("conv_id", F.col("id").alias("placeholder")).agg(F.first("type").alias("type"), F.max_by("original", "place").alias("original"))
    return Fold(out, last)
