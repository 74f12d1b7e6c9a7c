"""Detection quality against labels: precision, recall, F1, false alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import java, js_trim


def entity_key(kind: Column, text: Column) -> Column:
    """By what entities are the same: type, and text in lower case with single spaces."""
    return F.concat(kind, F.lit("::"), F.lower(js_trim(F.regexp_replace(text, java(r"\s+"), " "))))


def matched(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer match of distinct keys with the flags tp, fp and fn (0 or 1)."""
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    a = actual.select(*keys).distinct().withColumn("_a", F.lit(1))
    both = e.join(a, keys, "full")
    has_e, has_a = F.col("_e").isNotNull(), F.col("_a").isNotNull()
    return both.select(*keys, (has_e & has_a).cast("int").alias("tp"), (~has_e & has_a).cast("int").alias("fp"), (has_e & ~has_a).cast("int").alias("fn"))


def scores(matches: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 by group, three decimals; empty denominators give 1, 1 and 0."""
    sums = matches.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    share = lambda a, b, empty: F.when(b > 0, a / b).otherwise(empty)
    p = share(F.col("tp"), F.col("tp") + F.col("fp"), 1.0)
    r = share(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)
    with_pr = sums.withColumn("p", p).withColumn("r", r)
    f = share(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"), 0.0)
    return with_pr.select(*by, "tp", "fp", "fn", F.round("p", 3).alias("precision"), F.round("r", 3).alias("recall"), F.round(f, 3).alias("f1"))


def false_alert_rate(normal: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Share of normal cases in which anything was found."""
    hits = entities.select(key).distinct().withColumn("_hit", F.lit(1))
    return normal.select(key).distinct().join(hits, key, "left").agg(
        F.count(F.lit(1)).alias("cases"), F.count("_hit").alias("alerts"), F.round(F.coalesce(F.avg(F.coalesce("_hit", F.lit(0))), F.lit(0.0)), 3).alias("rate")
    )
