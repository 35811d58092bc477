"""Shards: inclusive ranges of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.operators.columns import project
from tablemill.operators.predicates import id_range, unprocessed
from tablemill.plans.spec import TaskSpec

RECORD_KB, MEMORY_SHARE, TARGET_SECONDS = 5, 0.3, 15 * 60


def shard_size(optimal: int = 10_000, least: int = 1_000, most: int = 50_000, free_mb: float | None = None, records_per_second: float = 0.0) -> int:
    """The least of what is wanted, what fits in memory and what is done in a quarter of an hour, within limits."""
    by_memory = most if free_mb is None else int(free_mb * MEMORY_SHARE * 1024 / RECORD_KB)
    by_time = int(records_per_second * TARGET_SECONDS) if records_per_second > 0 else most
    return max(least, min(by_memory, by_time, optimal, most))


def shard_size_of(free_mb: Column, records_per_second: Column, optimal: int = 10_000, least: int = 1_000, most: int = 50_000) -> Column:
    """``shard_size`` for each row."""
    by_memory = F.coalesce(F.floor(free_mb * MEMORY_SHARE * 1024 / RECORD_KB), F.lit(most))
    by_time = F.when(records_per_second > 0, F.floor(records_per_second * TARGET_SECONDS)).otherwise(F.lit(most))
    return F.greatest(F.lit(least), F.least(by_memory, by_time, F.lit(optimal), F.lit(most))).cast("int")


def bounds(df: DataFrame, id_col: str) -> DataFrame:
    """One row: min_id, max_id (null for an empty table) and n_rows."""
    return df.agg(F.min(id_col).alias("min_id"), F.max(id_col).alias("max_id"), F.count(F.lit(1)).alias("n_rows"))


def shard_ranges(df: DataFrame, id_col: str, size: int) -> DataFrame:
    """(shard, lo, hi) for the table's id range, the last one clipped; no rows for an empty table. The bounds are asked for at once, and shards are rows of a range, however many there are."""
    if size < 1:
        raise ValueError("a shard holds one id at least")
    known = bounds(df.select(df[id_col].cast("bigint").alias("_id")), "_id").first()
    return ranges(df.sparkSession, 0, -1, size) if known["min_id"] is None else ranges(df.sparkSession, known["min_id"], known["max_id"], size)


def ranges(spark: SparkSession, low: int, high: int, size: int) -> DataFrame:
    """The same for known bounds, without a scan."""
    n = max(0, -(-(high - low + 1) // size))
    return spark.range(n).select(F.col("id").cast("int").alias("shard"), (F.col("id") * size + low).alias("lo"), F.least(F.col("id") * size + low + size - 1, F.lit(high)).alias("hi"))


def shard_of(id_col: Column, low: Column | int, size: int) -> Column:
    """The shard of an id; no shuffle, and sparse ids cost nothing."""
    return F.floor((id_col - low) / size).cast("bigint")


def load_shard(df: DataFrame, spec: TaskSpec, low: int, high: int, as_text: bool = False) -> DataFrame:
    """Unprocessed rows of a shard with their inputs, in order of ids."""
    return project(id_range(df.filter(unprocessed(df, spec)), spec.id_col, low, high), spec, as_text).orderBy(spec.id_col)
