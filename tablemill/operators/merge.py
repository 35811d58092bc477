"""Writing results back by key."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.operators.columns import with_outputs
from tablemill.plans.spec import TaskSpec


def set_cell(df: DataFrame, id_col: str, key: Any, column: str, value: Any) -> DataFrame:
    """One cell changed; an unknown id changes nothing."""
    return df.withColumn(column, F.when(F.col(id_col) == key, F.lit(value)).otherwise(F.col(column)))


def last_write(updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key. One aggregate that combines before the shuffle, so a key that is written very often is no hot spot."""
    rest = [c for c in updates.columns if c not in keys]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def greatest(updates: DataFrame, key: str) -> DataFrame:
    """One row of each key, the greatest by all its columns in their order."""
    rest = [c for c in updates.columns if c != key]
    return updates.groupBy(key).agg(F.max(F.struct(*rest)).alias("_last")).select(key, *[F.col("_last")[c].alias(c) for c in rest])


def set_cells(df: DataFrame, updates: DataFrame, id_col: str, order: str = "seq") -> DataFrame:
    """Cells changed by (id, column, value, order) rows: the last write to a cell wins; unknown ids and columns change nothing.

    ``value`` is cast to the column's type. One shuffle on the key, whatever the number of columns.
    """
    last = last_write(updates.select(F.col(id_col).alias("_k"), "column", "value", order), ["_k", "column"], order)
    by_id = last.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("value")))).alias("_new"))
    joined = df.join(by_id, df[id_col] == by_id["_k"], "left")
    cell = lambda c: F.try_element_at("_new", F.lit(c))
    return joined.select(*[F.col(c) if c == id_col else F.when(cell(c).isNotNull(), cell(c)["value"].cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in df.columns])


def error_marker(error_type: Column, message: Column) -> Column:
    """What a failed row gets in its outputs, so that it isn't taken up again."""
    return F.concat(F.lit("ERROR: "), error_type, F.lit(" - "), message)


def write_back(df: DataFrame, results: DataFrame, spec: TaskSpec, missing: str = "keep", on_failure: str = "leave", order: str | None = None) -> DataFrame:
    """``df`` with the results' outputs, matched by id.

    ``results`` has the id and outputs by alias, and perhaps ``_error`` and ``_error_type``. An output that results don't
    have, or have null, is kept, set to null or blanked (``missing``). Failed rows are left as they are or marked
    (``on_failure``). Results for unknown ids are dropped; of several for one id the last by ``order`` counts, and without it the greatest by all its columns, so that a run repeated gives the same.
    """
    if missing not in ("keep", "null", "blank") or on_failure not in ("leave", "mark"):
        raise ValueError("missing is keep, null or blank; on_failure is leave or mark")
    base = with_outputs(df, spec)
    if "_error" not in results.columns:
        results = results.withColumn("_error", F.lit(None).cast("string"))
    if "_error_type" not in results.columns:
        results = results.withColumn("_error_type", F.lit("system_error"))
    one = last_write(results, [spec.id_col], order) if order else greatest(results, spec.id_col)
    if on_failure == "leave":
        one = one.filter(F.col("_error").isNull())
    named = [a for a in spec.outputs if a in one.columns]
    slim = one.select(F.col(spec.id_col).alias("_key"), "_error", "_error_type", *[F.col(a).cast("string").alias(f"_r_{a}") for a in named])
    joined = base.join(slim, base[spec.id_col] == slim["_key"], "left")
    alias_of = {c: a for a, c in spec.outputs.items()}

    def cell(c: str) -> Column:
        old, kind = base[f"`{c}`"], base.schema[c].dataType
        new = F.col(f"_r_{alias_of[c]}") if alias_of[c] in named else F.lit(None).cast("string")
        absent = {"keep": old, "null": F.lit(None).cast(kind), "blank": F.lit("").cast("string")}[missing]
        got = F.when(new.isNotNull(), new.try_cast(kind)).otherwise(absent)
        if on_failure == "mark":
            got = F.when(F.col("_error").isNotNull(), error_marker(F.col("_error_type"), F.col("_error")).try_cast(kind)).otherwise(got)
        return F.when(F.col("_key").isNotNull(), got).otherwise(old).alias(c)

    return joined.select(*[cell(c) if c in alias_of else base[f"`{c}`"] for c in base.columns])


def unmatched(df: DataFrame, results: DataFrame, id_col: str) -> DataFrame:
    """Results whose id the table doesn't have."""
    return results.join(df.select(id_col), id_col, "left_anti")


def consecutive(df: DataFrame, row_col: str, by: list[str] | None = None, block: int = 1 << 16) -> DataFrame:
    """(by.., lo, hi, n): runs of consecutive integers, repeated ones counted once.

    Runs are found within blocks of the number line, each a window of bounded size. Those that reach a block's border,
    two for each block at most, are then stitched; all others are whole. So one group can hold most rows.
    """
    by = by or []
    nums = df.select(*by, F.col(row_col).cast("bigint").alias("_v")).where("_v is not null").distinct().withColumn("_b", F.floor(F.col("_v") / block))
    in_block = Window.partitionBy(*by, "_b").orderBy("_v")
    small = nums.withColumn("_g", F.col("_v") - F.row_number().over(in_block)).groupBy(*by, "_b", "_g").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    inner = (F.col("lo") > F.col("_b") * block) & (F.col("hi") < F.col("_b") * block + block - 1)
    order = Window.partitionBy(*by).orderBy("lo") if by else Window.orderBy("lo")
    starts = F.sum(F.when(F.lag("hi").over(order) + 1 == F.col("lo"), 0).otherwise(1)).over(order)
    stitched = small.where(~inner).withColumn("_run", starts).groupBy(*by, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    runs = small.where(inner).select(*by, "lo", "hi").unionByName(stitched.select(*by, "lo", "hi"))
    return runs.select(*by, "lo", "hi", (F.col("hi") - F.col("lo") + 1).alias("n"))
