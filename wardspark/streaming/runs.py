"""Answered requests into the store's tables: sessions, messages, events and audit, each batch once however often it is replayed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("sessions", "messages", "events", "audit")
# What an audit row is about.
STEPS = ("request_received", "prompt_scanned", "policy_decided", "provider_called", "response_returned")


def _id(*parts) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 32)


def run_tables(runs: DataFrame) -> dict[str, DataFrame]:
    """The rows that runs leave. runs: run_id, conversation_id, company_slug, title, provider, model, action, preview, answer_preview, risk_score, flags, provider_called, at.

    Raw texts are never stored, only previews. Ids follow from the run, so the same run gives the same rows. A run
    without a conversation has a session of its own. An answer has a message only if there is one.
    """
    session = F.coalesce("conversation_id", _id(F.lit("session"), F.col("run_id").cast("string")))
    base = runs.withColumn("session_id", session)
    newest = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("at"), F.desc("run_id")))
    said = F.array(F.struct(F.lit("user").alias("role"), F.col("preview").alias("text")), F.struct(F.lit("assistant").alias("role"), F.col("answer_preview").alias("text")))
    steps = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(s).alias("event_type"), (F.lit(True) if s != "provider_called" else F.col("provider_called")).alias("held")) for i, s in enumerate(STEPS)])
    key = F.col("run_id").cast("string")
    return {
        "sessions": base.withColumn("_k", newest).where("_k = 1").select(F.col("session_id").alias("id"), F.substring(F.coalesce("title", F.lit("New chat")), 1, 80).alias("title"), "company_slug", F.col("at").alias("updated_at")),
        "messages": base.select("*", F.explode(said).alias("m")).where("m.text is not null").select(
            _id(F.col("m.role"), key).alias("id"), "session_id", "m.role", F.col("m.text").alias("redacted_preview"), F.lit(False).alias("raw_stored"), "provider", "model", "risk_score", F.col("action").alias("policy_action"), F.col("at").alias("created_at")),
        "events": base.select(
            _id(F.lit("event"), key).alias("id"), "session_id", "company_slug", F.col("action").alias("action_taken"), "provider", "risk_score", "flags", F.col("preview").alias("redacted_preview"), F.col("at").alias("created_at")),
        "audit": base.select("*", F.explode(steps).alias("s")).where("s.held").select(_id(F.lit("audit"), key, F.col("s.place").cast("string")).alias("id"), "session_id", "s.event_type", F.col("at").alias("created_at")),
    }


def persist(runs: DataFrame, batch_id: int, root: str) -> None:
    """Write the rows of one batch; each table's folder of that batch is replaced, so a replay leaves what was there.

    A batch that fails between two tables is written whole again when the stream restarts.
    """
    for name, rows in run_tables(runs).items():
        rows.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")


def persisted(stream: DataFrame, root: str):
    """A writer for a stream of runs."""
    return stream.writeStream.foreachBatch(lambda batch, batch_id: persist(batch, batch_id, root))


def stored_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table as it stands: sessions by their last batch, other rows as they were written."""
    rows = spark.read.parquet(f"{root}/{name}")
    if name != "sessions":
        return rows.drop("batch_id")
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("updated_at"), F.desc("batch_id")))
    return rows.withColumn("_k", last).where("_k = 1").drop("_k", "batch_id")
