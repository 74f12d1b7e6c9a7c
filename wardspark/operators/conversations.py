"""Conversation state in batch: recent history, known values in texts, moved vaults, rehydration. The fold itself is in folds.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import rehydrated


def recent_history(messages: DataFrame, last: int = 8) -> DataFrame:
    """The last user and assistant messages of each conversation that are not blank, oldest first."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    said = messages.where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    return said.withColumn("back", F.row_number().over(order)).where(F.col("back") <= last).select("conv_id", "turn", "role", "text", "back")


def known_entities(text: Column, vault: Column) -> Column:
    """Places at which values of a vault (array of id, type, original) stand in a text, between word boundaries; names in any case, secrets never."""

    def places(v: Column) -> Column:
        literal = F.concat(F.lit("\\Q"), F.replace(v["original"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        edge = F.lit("(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")
        pattern = F.concat(F.when(v["type"] == "PERSON", "(?iu)").otherwise(""), edge, literal, edge)
        found = F.regexp_extract_all(text, pattern, F.lit(0))
        parts = F.arrays_zip(F.split(text, pattern, -1).alias("b"), found.alias("m"))

        def add(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["b"])
            new = F.struct(start.alias("start"), (start + F.length(x["m"])).alias("stop"), v["id"].alias("id"), v["type"].alias("type"))
            return F.struct((start + F.length(x["m"])).alias("at"), F.array_append(acc["out"], new).alias("out"))

        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,id:string,type:string>>").alias("out"))
        return F.aggregate(F.slice(parts, F.lit(1), F.size(found)), empty, add, lambda acc: acc["out"])

    return F.flatten(F.transform(F.filter(vault, lambda v: (v["type"] != "SECRET") & (v["original"] != "")), places))


def without_overlaps(primary: Column, secondary: Column) -> Column:
    """Both arrays of (start, stop, id, type) in order of place; of the second those that overlap nothing taken before."""
    clash = lambda acc, x: F.exists(acc, lambda y: (y["start"] < x["stop"]) & (x["start"] < y["stop"]))
    return F.array_sort(F.aggregate(secondary, primary, lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.array_append(acc, x))))


def migrated(vaults: DataFrame, moves: DataFrame) -> DataFrame:
    """Vault rows with those of ``source`` also under ``target``; a source's value wins over the target's, and stays."""
    moved = vaults.join(moves.select(F.col("source").alias("conv_id"), "target"), "conv_id").select(F.col("target").alias("conv_id"), "type", "original", "placeholder")
    kept = vaults.join(moved.select("conv_id", "placeholder"), ["conv_id", "placeholder"], "left_anti").select(*moved.columns)
    return kept.unionByName(moved)


def rehydrate_messages(messages: DataFrame, vaults: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Messages with their conversation's placeholders put back: conv_id, turn, text, replaced, unresolved.

    Where nothing is put back though placeholders stand there, ``fallback`` (conv_id, placeholder, original: the vault
    of the draft that the conversation came from) is tried.
    """
    empty = F.array().cast("array<struct<id:string,original:string>>")
    maps = lambda rows, name: rows.groupBy("conv_id").agg(F.collect_list(F.struct(F.col("placeholder").alias("id"), "original")).alias(name))
    joined = messages.join(maps(vaults, "vault"), "conv_id", "left")
    if fallback is not None:
        joined = joined.join(maps(fallback, "draft"), "conv_id", "left")
    text = F.coalesce("text", F.lit(""))
    done = joined.select("*", rehydrated(text, F.coalesce("vault", empty)).alias("h"))
    if fallback is not None:
        again = (F.col("h.replaced") == 0) & (F.size("h.unresolved") > 0) & F.col("draft").isNotNull()
        done = done.withColumn("h", F.when(again, rehydrated(text, F.coalesce("draft", empty))).otherwise(F.col("h")))
    return done.select("conv_id", "turn", "h.*")


def pruned_drafts(drafts: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Draft vault rows (with saved_at) that are not older than so many minutes."""
    return drafts.where(F.col("saved_at") >= now - F.make_dt_interval(mins=F.lit(minutes)))
