"""Filters: single comparisons, and which rows are still to be processed."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tablemill.functions.emptiness import is_empty
from tablemill.plans.spec import TaskSpec, identifier

CONDITIONS = ("empty", "not_empty", "eq", "ne", "gt", "lt", "ge", "le")


def condition(df: DataFrame, column: str, op: str, value: Any = None, null_safe: bool = False) -> Column:
    """A comparison of one column. An unknown column holds nowhere; an unknown comparison is an error.

    ``ne`` leaves out nulls as SQL does, or keeps them with ``null_safe``.
    """
    if column not in df.columns:
        return F.lit(False)
    col = df[f"`{column}`"]
    made = {
        "empty": lambda: is_empty(df, column),
        "not_empty": lambda: ~is_empty(df, column),
        "eq": lambda: col == value,
        "ne": lambda: ~col.eqNullSafe(value) if null_safe else col != value,
        "gt": lambda: col > value,
        "lt": lambda: col < value,
        "ge": lambda: col >= value,
        "le": lambda: col <= value,
    }
    if op not in made:
        raise ValueError(f"unknown condition: {op}")
    return made[op]()


def filter_ids(df: DataFrame, id_col: str, column: str, op: str, value: Any = None, null_safe: bool = False) -> DataFrame:
    return df.filter(condition(df, column, op, value, null_safe)).select(id_col)


def inputs_valid(df: DataFrame, spec: TaskSpec) -> Column:
    """All inputs (a missing column is invalid) or any of them (a missing column is ignored) are not empty."""
    return reduce(and_ if spec.require_all else or_, [~is_empty(df, c, spec.mode) for c in spec.inputs])


def unprocessed(df: DataFrame, spec: TaskSpec) -> Column:
    """Inputs valid and any output empty, as one predicate that goes to the scan as far as the source can take it."""
    return inputs_valid(df, spec) & reduce(or_, [is_empty(df, c, spec.mode) for c in spec.output_columns])


def processed(df: DataFrame, spec: TaskSpec) -> Column:
    """No output empty."""
    return reduce(and_, [~is_empty(df, c, spec.mode) for c in spec.output_columns])


def status(df: DataFrame, spec: TaskSpec) -> Column:
    """``processed``, ``unprocessed`` or ``invalid`` (inputs missing): every row is one of them."""
    return F.when(processed(df, spec), "processed").when(unprocessed(df, spec), "unprocessed").otherwise("invalid")


def unprocessed_sql(spec: TaskSpec) -> str:
    """The same predicate as SQL text, with the emptiness that SQL stores can evaluate."""
    some = lambda c: f"({identifier(c)} IS NOT NULL AND {identifier(c)} <> '')"
    none = lambda c: f"({identifier(c)} IS NULL OR {identifier(c)} = '')"
    return f"({(' AND ' if spec.require_all else ' OR ').join(map(some, spec.inputs))}) AND ({' OR '.join(map(none, spec.output_columns))})"


def processed_sql(spec: TaskSpec) -> str:
    return " AND ".join(f"({identifier(c)} IS NOT NULL AND {identifier(c)} <> '')" for c in spec.output_columns)


def id_range(df: DataFrame, id_col: str, low: int, high: int) -> DataFrame:
    """Rows with low <= id <= high."""
    return df.filter(F.col(id_col).between(low, high))


def row_at(df: DataFrame, id_col: str, value: Any) -> Row:
    """The row with this id, or IndexError."""
    found = df.filter(F.col(id_col) == value).head(1)
    if not found:
        raise IndexError(value)
    return found[0]


def rows_at(df: DataFrame, id_col: str, ids: Sequence) -> DataFrame:
    """The rows with these ids in the order given, unknown ones left out. The ids are the caller's list, so they fit a filter."""
    place = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col(id_col)) if ids else F.lit(0)
    return df.filter(F.col(id_col).isin(list(ids))).withColumn("_place", place).orderBy("_place").drop("_place")


def sample_rows(df: DataFrame, spec: TaskSpec, n: int, done: bool = False, columns: Iterable[str] | None = None) -> DataFrame:
    """The first n rows by id that are unprocessed (or processed)."""
    keep = list(columns) if columns is not None else (spec.output_columns if done else list(spec.inputs))
    rows = df.filter(processed(df, spec) if done else unprocessed(df, spec))
    return rows.select(spec.id_col, *[c for c in keep if c in df.columns and c != spec.id_col]).orderBy(spec.id_col).limit(n)


def reload(df: DataFrame, failed: DataFrame, id_col: str) -> DataFrame:
    """The current rows of the ids in ``failed``, read again before a retry."""
    return df.join(failed.select(id_col).distinct(), id_col, "left_semi")


def all_rows(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Every row, whatever its state; unknown columns are dropped."""
    return df.select(*[c for c in columns if c in df.columns])


def processed_rows(df: DataFrame, spec: TaskSpec, columns: Iterable[str] | None = None) -> DataFrame:
    return all_rows(df.filter(processed(df, spec)), spec.output_columns if columns is None else columns)
