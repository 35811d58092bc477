"""Projections and column operations."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tablemill.functions.emptiness import to_text
from tablemill.plans.spec import TaskSpec


def project(df: DataFrame, spec: TaskSpec, as_text: bool = False) -> DataFrame:
    """The id and the inputs that exist, as they are or as text."""
    names = [c for c in spec.inputs if c in df.columns]
    return df.select(spec.id_col, *[to_text(df, c).alias(c) if as_text else F.col(f"`{c}`") for c in names if c != spec.id_col])


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def add_column(df: DataFrame, name: str, value: Any = None, kind: str = "string") -> DataFrame:
    """A constant column; a column that exists stays as it is."""
    return df if name in df.columns else df.withColumn(name, F.lit(value).cast(kind) if value is None else F.lit(value))


def with_outputs(df: DataFrame, spec: TaskSpec) -> DataFrame:
    """Output columns that don't exist are added, empty."""
    for c in spec.output_columns:
        df = add_column(df, c)
    return df


def to_physical(df: DataFrame, outputs: Mapping[str, str]) -> DataFrame:
    """Result columns from aliases to the table's names."""
    return df.select(*[F.col(f"`{c}`").alias(outputs.get(c, c)) for c in df.columns])


def rows(df: DataFrame, columns: Sequence[str] | None = None) -> Iterator[Row]:
    """Row by row, a partition at a time; unknown columns are dropped."""
    return (df if columns is None else df.select(*[c for c in columns if c in df.columns])).toLocalIterator()


def ids(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(id_col)
