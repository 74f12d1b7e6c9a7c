"""Helpers that the operators share."""

import pyarrow as pa
from pyspark.sql import functions as F

from wardspark.llm import common


def test_stored_tables_hand_rows_to_python_in_small_batches(spark):
    rows = spark.range(0, 300, 1, 1).select("id", F.repeat(F.lit("x"), 100_000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    before = spark.conf.get(common.BATCH_CONF)
    got = common.stored(rows.mapInArrow(sizes, "n long, size long"), "sizes").collect()
    assert sum(r["n"] for r in got) == 300
    assert max(r["size"] for r in got) < 2 * common.BATCH_BYTES
    assert spark.conf.get(common.BATCH_CONF) == before
