"""What a draft's events come to in batch: which scans a pause lets through, and when files let a message go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What files do to the gate; a step that is not listed changes nothing.
STEPS = {
    ("select", "none"): "pending", ("select", "pending"): "pending", ("select", "governed"): "pending", ("select", "blocked"): "pending",
    ("allow", "pending"): "governed", ("refuse", "pending"): "blocked", ("clear", "governed"): "none",
}
STATES = ("none", "pending", "governed", "blocked")
#: Pauses after which a draft and an answer are scanned.
DRAFT_PAUSE, ANSWER_PAUSE = "300 milliseconds", "500 milliseconds"
# Why a message may not go.
WAITING = "This file is still being scanned. Wait for governance before sending."
REFUSED = "Attachment upload is blocked. File was not uploaded."
UNVERIFIED = "This attachment is not verified. Remove it and upload it again."


def debounced(edits: DataFrame, by: list[str], ts: str = "at", seq: str = "seq", text: str = "text", pause: str = DRAFT_PAUSE) -> DataFrame:
    """Edits that are scanned: those that no other edit of the same draft follows before the pause is over, blank ones never.

    Edits of one time are in the order of ``seq``; of those only the last can pass. Rows without a time never pass.
    """
    order = Window.partitionBy(*by).orderBy(ts, seq)
    following = F.lead(ts).over(order)
    rows = edits.where(F.col(ts).isNotNull()).withColumn("_next", following)
    passes = F.col("_next").isNull() | (F.col("_next") >= F.col(ts) + F.expr(f"interval {pause}"))
    return rows.where(passes & (F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "") != "")).drop("_next")


def gate_states(steps: DataFrame, by: list[str], ts: str = "at", seq: str = "seq", step: str = "step") -> DataFrame:
    """Steps with the state of the gate after each: none, pending, governed or blocked.

    Each step is a map of states to states, and such maps compose. As ``select`` leads to pending from anywhere, what counts is
    the last one, the first verdict after it, and for a governed file whether it was cleared since: running windows, no loop.
    """
    order = Window.partitionBy(*by).orderBy(ts, seq)
    rows = steps.withColumn("_round", F.sum(F.when(F.col(step) == "select", 1).otherwise(0)).over(order))
    inside = Window.partitionBy(*by, "_round").orderBy(ts, seq).rowsBetween(Window.unboundedPreceding, 0)
    verdict = F.first(F.when(F.col(step).isin("allow", "refuse"), F.col(step)), True).over(inside)
    rows = rows.withColumn("_verdict", verdict).withColumn("_cleared", F.max(F.when((F.col(step) == "clear") & (F.col("_verdict") == "allow"), 1)).over(inside))
    state = (
        F.when(F.col("_round") == 0, "none").when(F.col("_verdict").isNull(), "pending").when(F.col("_verdict") == "refuse", "blocked")
        .when(F.col("_cleared").isNotNull(), "none").otherwise("governed")
    )
    return rows.withColumn("state", state).drop("_round", "_verdict", "_cleared")


def send_problem(state: Column, has_files: Column, notice: Column, phase: Column, message: Column) -> Column:
    """Why a message may not go, or null."""
    return (
        F.when(state == "pending", WAITING)
        .when(notice & phase.isin("blocked", "failed"), F.when(message != "", message).otherwise(REFUSED))
        .when(has_files & (state != "governed"), UNVERIFIED)
    )
