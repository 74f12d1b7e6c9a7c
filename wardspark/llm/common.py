"""Shared helpers: tables, shared-folder storage, sized broadcasts, components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured rows times its row width stay below this.
BROADCAST_BYTES = 32 << 20
#: Bytes of input, as Spark estimates them from its files, for a partition of a stage that holds whole texts.
PARTITION_BYTES = 128 << 20
#: Bytes of rows that go to a Python worker at once. Spark's 64 MB are held several times over, off the heap and in the worker.
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; set here only when a local session names none."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Removes what ``stored`` writes inside it once it ends: write results before that, as they read those tables."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs started inside hand rows to Python by BATCH_BYTES; the session's setting comes back afterwards."""
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives executors. See scratch for its removal."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for made in _scopes[-1:]:
        made.append(path)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame) -> int:
    """At least spark.sql.shuffle.partitions, more for large files below df; tables of unknown size don't count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // PARTITION_BYTES))


def sized(small: DataFrame, row_bytes: int) -> DataFrame:
    """Mark a stored table for broadcast if its size is proven small; else leave the join to Spark."""
    return F.broadcast(small) if small.count() * row_bytes <= BROADCAST_BYTES else small


def clean_words(text):
    """Lower-case ASCII-delimited words: runs of ASCII letters and digits and of any non-ASCII characters."""
    return F.filter(F.split(F.lower(text), "[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+"), lambda w: w != "")


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) of every node in edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star contraction. Each round costs two grouped
    minima and two joins over the remaining edges; state goes through the shared folder.
    Self-loops are kept as single nodes. Null ends are dropped.
    """
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u is not null and v is not null")
    nodes_self = e.where("u = v").select("u", "v")
    e = e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stored(e.unionByName(nodes_self.distinct()), "edges")
    loops = e.where("u = v").select(F.col("u").alias("node"))
    cur = e.where("u <> v")
    for _ in range(max_rounds):
        if cur.isEmpty():
            break
        # Large-star: larger neighbours attach to the smallest of the closed neighbourhood.
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # Small-star: smaller neighbours and the node attach to the smallest of them.
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = stored(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        inner = cur.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
        if inner and cur.join(cur.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    stars = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    known = stars.unionByName(roots)
    single = loops.join(known.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")).distinct()
    return known.unionByName(single)
