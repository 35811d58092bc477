"""Opening sources by configuration."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tablemill.sources import files, jdbc
from tablemill.sources.rest import RestTableSource
from tablemill.sources.sqlite import SqliteSource
from tablemill.sources.xlsx import XlsxSource

Opener = Callable[[SparkSession, Mapping[str, Any]], DataFrame]


def register_all(spark: SparkSession) -> None:
    """Make the formats ``sqlite_table``, ``xlsx`` and ``rest_table`` known to the session."""
    for source in (SqliteSource, XlsxSource, RestTableSource):
        spark.dataSource.register(source)


def _needs(options: Mapping, *keys: str) -> None:
    if gone := [k for k in keys if not options.get(k)]:
        raise ValueError(f"missing options: {', '.join(gone)}")


def _sqlite(spark: SparkSession, o: Mapping) -> DataFrame:
    _needs(o, "db_path", "table_name")
    register_all(spark)
    return spark.read.format("sqlite_table").options(path=o["db_path"], table=o["table_name"], id_col=o.get("id_col", "id"), partitions=str(o.get("partitions", 8))).load()


def _xlsx(spark: SparkSession, o: Mapping) -> DataFrame:
    _needs(o, "input_path")
    register_all(spark)
    return files.read(spark, o["input_path"], "xlsx", {"sheet": o.get("sheet", 0)})


def _rest(kind: str) -> Opener:
    def run(spark: SparkSession, o: Mapping) -> DataFrame:
        _needs(o, "transport", "app_token" if kind == "bitable" else "spreadsheet_token")
        register_all(spark)
        return spark.read.format("rest_table").options(kind=kind, **{k: str(v) for k, v in o.items() if k != "type"}).load()

    return run


OPENERS: dict[str, Opener] = {
    "parquet": lambda s, o: files.read(s, o["input_path"], "parquet"),
    "csv": lambda s, o: files.read(s, o["input_path"], "csv", o.get("options")),
    "json": lambda s, o: files.read(s, o["input_path"], "json", o.get("options")),
    "orc": lambda s, o: files.read(s, o["input_path"], "orc"),
    "excel": lambda s, o: _xlsx(s, o) if files.kind_of(o["input_path"]) == "xlsx" else files.read(s, o["input_path"], files.kind_of(o["input_path"])),
    "xlsx": _xlsx,
    "sqlite": _sqlite,
    "mysql": lambda s, o: jdbc.table(s, jdbc.mysql(o), o),
    "postgresql": lambda s, o: jdbc.table(s, jdbc.postgresql(o), o),
    "bitable": _rest("bitable"),
    "sheet": _rest("sheet"),
}


def register(kind: str, opener: Opener) -> None:
    OPENERS[kind] = opener


def open_source(spark: SparkSession, options: Mapping[str, Any]) -> DataFrame:
    """The table that ``options`` (type and what that type needs) describe."""
    kind = str(options.get("type", "")).lower()
    if kind not in OPENERS:
        raise ValueError(f"unknown source type: {kind!r}; known: {', '.join(sorted(OPENERS))}")
    if kind in ("parquet", "csv", "json", "orc", "excel"):
        _needs(options, "input_path")
    return OPENERS[kind](spark, options)


def capabilities() -> dict[str, bool]:
    """Which optional libraries are there; none of them is needed by the sources above but JDBC drivers."""
    return {n: importlib.util.find_spec(n) is not None for n in ("pandas", "pyarrow", "duckdb", "openpyxl", "psycopg2", "pymysql", "tiktoken")}
