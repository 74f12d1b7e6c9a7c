"""Benchmark decontamination by size-partitioned MinHash containment (operator 7).

Items are partitioned by the size of their shingle sets. An item's sketch holds its smallest
shingle hashes, a bottom-k MinHash sample; k belongs to the size partition and is more than the
shingles that an item of the partition may lack, so none is missed. A document has an
item as a candidate if it holds a shingle of the item's sketch; shingles beyond the largest hash
of all sketches of their length are not looked up. A document is long, so its side of the search is all
its shingles and not a sketch that would lose short items. Candidates are verified by exact
containment of the shingle sets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import clean_words, sized, stored


#: No 64-bit hash is larger.
TOP = (1 << 63) - 1


def runs(w: Column, size: int, hashed) -> Column:
    """Hashes of the runs of ``size`` elements of an array with at least as many."""
    return F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[hashed(F.get(w, i + k)) for k in range(size)]))


def document_shingles(docs: DataFrame, ceilings: dict[int, int]) -> DataFrame:
    """(doc_id, length, h) rows of docs (doc_id, text), repeats included: of each length in ``ceilings`` the hashes up to its ceiling."""
    # Words are hashed in a step of their own so that they are hashed once.
    words = docs.select("doc_id", F.transform(clean_words(F.col("text")), lambda w: F.xxhash64(w)).alias("w")).where(F.size("w") >= min(ceilings))
    none = F.array().cast("array<bigint>")

    def of(length: int, top: int) -> Column:
        all_ = F.when(F.size("w") >= length, runs(F.col("w"), length, lambda x: x)).otherwise(none)
        return F.transform(all_ if top >= TOP else F.filter(all_, lambda h: h <= top), lambda h: F.struct(F.lit(length).alias("length"), h.alias("h")))

    return words.select("doc_id", F.explode(F.concat(*[of(*x) for x in sorted(ceilings.items())])).alias("x")).select("doc_id", "x.*")


def item_shingles(items: DataFrame, shingle: int) -> DataFrame:
    """(item_id, length, h, q): different shingles of each item, their length in words and number."""
    words = items.select("item_id", clean_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    rows = []
    for size in range(1, shingle + 1):
        here = words.where(F.size("w") >= size if size == shingle else F.size("w") == size)
        rows.append(here.select("item_id", F.lit(size).alias("length"), F.explode(runs(F.col("w"), size, F.xxhash64)).alias("h")))
    rows = reduce(DataFrame.unionByName, rows).distinct()
    return rows.withColumn("q", F.count(F.lit(1)).over(Window.partitionBy("item_id")))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.8,
    shingle: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document and item that it contains: doc_id, item_id, shared, item_shingles, containment.

    Containment is the share of the item's different shingles that the document has; pairs from
    ``threshold`` on are returned. A sketch of more than (1 - threshold) x q of an item's q hashes
    cannot be missed by a document that holds the rest, so every item is found.

    Items of fewer words than a shingle are one shingle of their words. Null, empty and wordless
    items and documents match nothing; null ids are dropped. Items that repeat an id count as one
    item with the shingles of all its rows; so do documents. Empty tables give no rows. Other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    wanted = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and text is not null")
    shingles = stored(item_shingles(wanted, shingle), "item-shingles")
    # Size partitions are powers of two; the largest item of a partition sets its sketch size.
    part = F.floor(F.log2("q")).cast("int")
    ranked = shingles.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("h", "length")))
    tops = shingles.groupBy(part.alias("part")).agg(F.max("q").alias("most"))
    need = F.floor(F.lit(1 - threshold) * F.col("most") + 1e-9) + 1
    sketches = ranked.join(tops, "part").where(F.col("rank") <= need).select("item_id", "length", "part", "h")
    sketches = stored(sketches, "item-sketches")
    ceilings = {r["length"]: r["h"] for r in sketches.groupBy("length").agg(F.max("h").alias("h")).collect()}  # at most ``shingle`` rows
    if not ceilings:
        return rows.sparkSession.createDataFrame(
            [], f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {wanted.schema['item_id'].dataType.simpleString()}, shared long, item_shingles long, containment double"
        )
    gram = ["length", "h"]
    keys = sized(stored(sketches.select(*gram).distinct(), "sketch-keys"), 24)
    candidates = stored(document_shingles(rows, ceilings).join(keys, gram, "left_semi").select("doc_id").distinct(), "candidate-docs")
    texts = rows.join(sized(candidates, 16), "doc_id", "left_semi")
    grams = document_shingles(texts, dict.fromkeys(ceilings, TOP))
    # An item's sketch tells its candidates and all its shingles are counted: both from one pass over the texts that are left.
    whole = shingles.join(sketches.select("item_id", *gram, F.lit(1).alias("sketched")), ["item_id", *gram], "left")
    whole = sized(stored(whole.select("item_id", *gram, "q", "sketched"), "item-grams"), 48)
    shared = grams.join(whole, gram).groupBy("doc_id", "item_id", "q", *gram).agg(F.max("sketched").alias("sketched"))
    out = shared.groupBy("doc_id", "item_id", "q").agg(F.count(F.lit(1)).alias("shared"), F.max("sketched").alias("sketched")).where("sketched is not null")
    return out.select(
        "doc_id", "item_id", "shared", F.col("q").alias("item_shingles"), (F.col("shared") / F.col("q")).alias("containment")
    ).where(F.col("containment") >= threshold)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Rows of docs that contain no item. All rows of an id go together; null ids and null texts stay; an empty table gives no rows."""
    bad = stored(contaminated(docs, items, id_col=id_col, **options).select("doc_id").distinct(), "contaminated")
    return docs.join(sized(bad, 16), docs[id_col] == bad["doc_id"], "left_anti")
