"""Folds over rows in order, as aggregates of blocks.

Rows are dealt to tasks by ranges of their order, not by key, so a key with very many rows is spread over many tasks. Each task folds
its range to a row per key, and a key's rows (one for each range at most) are put together in order. This needs a fold whose blocks
can be combined: a moving average is an affine map, and failures since the last success a suffix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocks(df: DataFrame, key: str, order: Sequence[str | Column], fold: Callable[[pd.DataFrame, dict], None], out: list[str], ddl: str) -> DataFrame:
    """(key, part, out..): ``fold(rows, state)`` takes a batch of a range, in order, into ``state`` (a list of ``out`` by key).

    ``df`` has the key and what ``fold`` reads. A task holds a row per key of its range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        for rows in batches:
            fold(rows, state)
        keys = list(state)
        for lo in range(0, len(keys), 1 << 14):
            some = keys[lo : lo + (1 << 14)]
            yield pd.DataFrame({key: some, "part": TaskContext.get().partitionId(), **{c: [state[k][i] for k in some] for i, c in enumerate(out)}})

    laid = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return laid.mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, part int, {ddl}")


def plain(values: pd.Series) -> pd.Series:
    """Keys with every missing value as None, so that they are one key."""
    return values.astype(object).where(values.notna(), None)


def in_order(columns: Sequence[str]) -> Column:
    """A key's blocks as one array, in order; there are no more than ranges."""
    return F.array_sort(F.collect_list(F.struct("part", *columns)))
