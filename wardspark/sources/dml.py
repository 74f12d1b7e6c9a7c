"""Table changes as rewrites: upsert, ignore on conflict, guarded update and delete, constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changed rows replace those with the same keys; null keys never match. Changes must be unique by key."""
    return target.join(changes.select(*keys), keys, "left_anti").select(*target.columns).unionByName(changes.select(*target.columns))


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not there yet are added."""
    return target.unionByName(rows.join(target.select(*keys), keys, "left_anti").dropDuplicates(keys).select(*target.columns))


def update_where(target: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return target.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    return target.where(~F.coalesce(condition, F.lit(False)))


def backfill(target: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return target.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in target.columns])


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose reference has no parent."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def unique_violations(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """Keys that more than one row has; rows with a null key are left out."""
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    full = reduce(Column.__and__, [F.col(f"k{i}").isNotNull() for i in range(len(keys))])
    return rows.select(*named).where(full).groupBy(*[f"k{i}" for i in range(len(keys))]).count().where("count > 1")
