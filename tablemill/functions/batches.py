"""Bounds of what goes to Python at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows, and bytes, in an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of BATCH_ROWS and about BATCH_BYTES at most, as they can be long.

    These are settings of the session, read when a plan runs and so left in place; ones other than Spark's defaults stay.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) == 10000:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))
