"""Counts and statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.operators.folds import blocks, in_order, plain
from tablemill.operators.predicates import processed, unprocessed
from tablemill.plans.spec import TaskSpec


def counts(df: DataFrame, spec: TaskSpec) -> DataFrame:
    """One row: n_rows, n_unprocessed, n_processed, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(unprocessed(df, spec)).alias("n_unprocessed"), F.count_if(processed(df, spec)).alias("n_processed"))


def progress_percent(done: Column, total: Column) -> Column:
    """100 for nothing to do."""
    return F.when(total <= 0, F.lit(100.0)).otherwise(done / total * 100)


def percentile_ranks(n: Column, percents: tuple[int, ...]) -> list[Column]:
    """Places (from 0) of percentiles among n sorted values: n * p / 100 rounded down, within the values."""
    return [F.least(F.floor(n * p / 100), n - 1) for p in percents]


def token_stats(df: DataFrame, value: str, total_rows: int | Column | None = None, percents: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """One row: total_estimated, avg, min, max, p50, p90, p99, sample_count; zeros for no values, nulls left out.

    Percentiles are exact at any size: values are counted (combined before the shuffle), and only the counts, a row for
    each different value, are ordered. total_estimated is the mean times ``total_rows`` (the values' number by default), cut to a whole number.
    """
    tally = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("bigint").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    order = Window.orderBy("v")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = tally.select("v", "c", F.sum("c").over(upto).alias("upto"), F.sum("c").over(every).alias("n"))
    picks = [F.min(F.when(F.col("upto") > place, F.col("v"))).alias(f"p{p}") for p, place in zip(percents, percentile_ranks(F.col("n"), percents), strict=True)]
    row = ranked.agg(F.sum("c").alias("sample_count"), F.sum(F.col("c") * F.col("v")).alias("_sum"), F.min("v").alias("min"), F.max("v").alias("max"), *picks)
    n = F.col("sample_count")
    total = n if total_rows is None else (F.lit(total_rows) if isinstance(total_rows, int) else total_rows)
    mean = F.col("_sum") / n
    zero = lambda c: F.coalesce(c, F.lit(0))
    return row.select(
        zero((mean * total).cast("bigint")).alias("total_estimated"), F.coalesce(F.round(mean, 2), F.lit(0.0)).alias("avg"), *[zero(F.col(c)).alias(c) for c in ("min", "max", *[f"p{p}" for p in percents])], zero(n).alias("sample_count")
    )


def ema(df: DataFrame, key: str, value: str, order: list[str], alpha: float = 0.1) -> DataFrame:
    """(key, ema, n): exponential moving average in order of ``order``; the first value starts it. Null values are left out, a null key is one too.

    A value takes the average e to (1 - alpha) e + alpha x, an affine map, and so does a block of values: ``shift`` is what a block
    gives to an average of 0. Blocks are put together in order, so a key of very many rows is folded by many tasks, for any alpha.
    """
    keep = 1 - alpha

    def fold(rows: pd.DataFrame, state: dict) -> None:
        keys = plain(rows["_k"])
        codes, known = pd.factorize(keys, use_na_sentinel=False)
        after = rows.groupby(codes).cumcount(ascending=False)
        shifts = (rows["_v"] * alpha * keep**after).groupby(codes).sum()
        sizes, firsts = rows["_v"].groupby(codes).size(), rows["_v"].groupby(codes).first()
        for code, k in enumerate(known):
            k = None if pd.isna(k) else k
            n, shift = int(sizes[code]), float(shifts[code])
            if k in state:
                old = state[k]
                old[1], old[2] = old[1] * keep**n + shift, old[2] + n
            else:
                state[k] = [float(firsts[code]), shift, n]

    known = df.where(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("_k"), F.col(value).cast("double").alias("_v"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    parts = blocks(known, "_k", [f"_o{i}" for i in range(len(order))], fold, ["first", "shift", "size"], "first double, shift double, size bigint")
    each = parts.groupBy("_k").agg(in_order(["first", "shift", "size"]).alias("_b"), F.sum("size").alias("n"))
    average = F.aggregate("_b", F.col("_b")[0]["first"], lambda e, x: e * F.pow(F.lit(keep), x["size"]) + x["shift"])
    return each.select(F.col("_k").cast(df.schema[key].dataType).alias(key), average.alias("ema"), "n")


def error_counts(df: DataFrame, kind: str) -> DataFrame:
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def last_errors(df: DataFrame, key: str, order: list[str], what: list[str], n: int = 5) -> DataFrame:
    """(key, rank from the oldest kept, what..): each key's last n rows; ranks are limited inside each task before rows move."""
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.select(key, *order, *[c for c in what if c not in order], F.row_number().over(newest).alias("rank")).where(F.col("rank") <= n)
