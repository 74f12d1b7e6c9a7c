"""Contiguous, byte-balanced shards from global prefix sums (operator 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, stored

#: monotonically_increasing_id() holds the partition above this bit and the row below it.
ROW_BITS = 33


def byte_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32): what sharding needs of each row, so no text is shuffled."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )


def assign_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, start, shard, slot.

    Rows are ordered by id (nulls first), then checksum and size. ``start`` is the number
    of bytes before a row; a row goes to the shard in which the middle of its bytes falls,
    so shards are contiguous and differ by less than the largest row. The order is a range
    partitioning; each partition's total goes into a prefix sum over the partitions (a few
    numbers a partition), and the running sum restarts within each partition.

    Null and empty texts have size 1 (the terminator). Equal rows take neighbouring slots in
    either order. An empty table gives no rows. Other columns are not read.
    """
    # The last key lets even one repeated row be dealt over many partitions.
    digest = byte_digest(docs, id_col, text_col)
    ordered = (
        digest.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(partitions_for(digest), "doc_id", "text_crc32", "size", "tie")
        .sortWithinPartitions("doc_id", "text_crc32", "size", "tie")
        .withColumn("at", F.monotonically_increasing_id())
        .select(
            "doc_id", "size", "text_crc32",
            F.shiftright("at", ROW_BITS).cast("int").alias("part"),
            F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("row"),
        )
    )
    ordered = stored(ordered, "shard-digest")  # the partitioning must be the same for totals and rows
    totals = ordered.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ordered.withColumn("run", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(F.broadcast(offsets), "part")  # one row per partition of the range partitioning
        .withColumn("start", F.col("bytes_before") + F.col("run"))
        .withColumn("index", F.col("rows_before") + F.col("row"))
    )
    middle = (F.col("start") * 2 + F.col("size")).cast("decimal(38,0)") * F.lit(n_shards)
    placed = placed.withColumn(
        "shard", F.least(F.floor(middle / (F.col("total").cast("decimal(38,0)") * 2)), F.lit(n_shards - 1)).cast("int")
    )
    firsts = placed.groupBy("shard").agg(F.min("index").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "start", "shard", (F.col("index") - F.col("first")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write whole rows into one folder per shard, ordered within it, and read them back: shard, slot, row.

    Rows meet their shard by id, checksum and the rank among rows that share both, so
    repeated rows go to as many slots as there are rows. Null ids and null texts are rows like others.
    An empty table gives no rows. Columns of docs are fields of ``row``, so none clashes.
    """
    key = Window.partitionBy("doc_id", "text_crc32").orderBy("slot_order")
    plan = assign_shards(docs, n_shards, id_col, text_col).withColumn("slot_order", F.struct("shard", "slot"))
    plan = plan.select("doc_id", "text_crc32", "shard", "slot", F.row_number().over(key).alias("copy"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.struct("*").alias("row"),
    )
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "text_crc32").orderBy(F.monotonically_increasing_id())))
    same = [rows[c].eqNullSafe(plan[c]) for c in ("doc_id", "text_crc32", "copy")]
    out = rows.join(plan, same).select(plan["shard"], plan["slot"], rows["row"])
    if out.isEmpty():
        return out
    # By range, so that a large shard is several tasks and files; their order is that of the slots.
    ranged = out.repartitionByRange(max(n_shards, partitions_for(docs)), "shard", "slot").sortWithinPartitions("shard", "slot")
    ranged.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
