"""Published rule bundles next to a stream: read again when they are old, kept when reading fails."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession

from ..operators.policy import evaluate

#: Fixed value: a bundle read is good for so many seconds.
FRESH_SECONDS = 60
#: Rules are what people write; a bundle of more is refused rather than carried to every row.
MOST_RULES = 10_000


class BundleCache:
    """The latest bundle's rules as a small table. ``read`` returns the published rules, or None if there are none.

    Within ``fresh`` seconds nothing is read. If reading fails, the last bundle stays; if it gives none, the last bundle
    serves this once and none after it, until the next read.
    """

    def __init__(self, read: Callable[[], DataFrame | None], fresh: float = FRESH_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.read, self.fresh, self.clock = read, fresh, clock
        self.at: float | None = None
        self.rules: tuple[list[Row], str] | None = None  # what serves now
        self.last: tuple[list[Row], str] | None = None  # the last bundle that was read
        self.problem: str | None = None

    def get(self) -> tuple[list[Row], object] | None:
        now = self.clock()
        if self.at is not None and now - self.at < self.fresh:
            return self.rules
        self.at, self.problem = now, None
        try:
            found = self.read()
            rows = found.limit(MOST_RULES + 1).collect() if found is not None else None
            if rows and len(rows) > MOST_RULES:
                raise ValueError(f"a bundle of more than {MOST_RULES} rules")
        except Exception as e:  # whatever the store says, the stream goes on with what it has
            self.problem = f"{type(e).__name__}: {e}"
            self.rules = self.last
            return self.last
        if not rows:
            self.rules = None
            return self.last
        self.rules = self.last = (rows, found.schema)
        return self.rules

    def table(self, spark: SparkSession, none: str) -> DataFrame:
        """The rules as a table, without rows (of schema ``none``) if no bundle serves."""
        rules = self.get()
        return spark.createDataFrame(*rules) if rules else spark.createDataFrame([], none)


RULE = (
    "rule_key string, version int, data_categories array<string>, ai_provider string, destination_type string, action string, fallback_action string, severity string, "
    "user_scope string, department_scope string, source_policy string, source_section string, explanation string"
)


def decide(signals: DataFrame, cache: BundleCache, write: Callable[[DataFrame, int], None], key: str = "doc_id"):
    """A writer that decides each micro-batch of a stream of signals by the bundle that serves then, and hands it to ``write``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        write(evaluate(batch, cache.table(batch.sparkSession, RULE), key), batch_id)

    return signals.writeStream.foreachBatch(each)
