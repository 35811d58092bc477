"""SQLite tables as a Spark data source: ranges of ids with equally many rows are read in parallel, results are written as one transaction.

Columns are pruned by selecting a schema, rows by the ``where`` option, which the store evaluates (``pending`` makes
it). Spark's own filter pushdown to Python sources isn't used: in 4.1 filters pushed for one query stay with the table
and are applied to the next one too.
"""

from __future__ import annotations

import pickle
import sqlite3
import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tablemill.operators.predicates import unprocessed_sql
from tablemill.plans.spec import TaskSpec, identifier

#: Declared types to Spark's, by what they contain, as SQLite decides on affinity.
_KINDS = (("INT", T.LongType()), ("CHAR", T.StringType()), ("CLOB", T.StringType()), ("TEXT", T.StringType()), ("REAL", T.DoubleType()), ("FLOA", T.DoubleType()), ("DOUB", T.DoubleType()), ("BLOB", T.BinaryType()))
LOCK_SECONDS = 30


def connect(path: str) -> sqlite3.Connection:
    if not Path(path).exists():
        raise FileNotFoundError(path)
    return sqlite3.connect(path, timeout=LOCK_SECONDS)


@dataclass
class IdRange(InputPartition):
    low: int
    high: int


@dataclass
class Staged(WriterCommitMessage):
    path: str


class SqliteSource(DataSource):
    """Options: path, table, id_col (``id``), partitions (8), where (SQL); for writing: mode append updates rows by id."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> T.StructType:
        table = identifier(self.options["table"])
        with connect(self.options["path"]) as c:
            found = c.execute(f"PRAGMA table_info({table})").fetchall()
        if not found:
            raise ValueError(f"no table {table}")
        kind = lambda d: next((k for s, k in _KINDS if s in (d or "").upper()), T.StringType())
        return T.StructType([T.StructField(name, kind(declared)) for _, name, declared, *_ in found])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return SqliteWriter(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.path, self.table, self.id_col = options["path"], identifier(options["table"]), identifier(options.get("id_col", "id"))
        self.n, self.schema = int(options.get("partitions", 8)), schema
        self.where = options.get("where")

    def partitions(self) -> Sequence[InputPartition]:
        """Ranges of about equally many rows, however ids are spread: each starts at the id of every so many rows, in one pass over the ids."""
        with connect(self.path) as c:
            low, high, n, odd = c.execute(f"SELECT min({self.id_col}), max({self.id_col}), count({self.id_col}), count(*) FILTER (WHERE typeof({self.id_col}) NOT IN ('integer', 'null')) FROM {self.table}").fetchone()
            if odd:
                raise ValueError(f"{self.id_col} must hold integers")
            if not n:
                return [IdRange(0, -1)]
            step = -(-n // self.n)
            starts = [r[0] for r in c.execute(f"SELECT DISTINCT id FROM (SELECT {self.id_col} AS id, row_number() OVER (ORDER BY {self.id_col}) - 1 AS k FROM {self.table} WHERE {self.id_col} IS NOT NULL) WHERE k % {step} = 0 ORDER BY id")]
        return [IdRange(a, b - 1) for a, b in zip(starts, [*starts[1:], high + 1], strict=True)]

    def read(self, part: IdRange) -> Iterator[tuple]:
        names = ", ".join(identifier(f.name) for f in self.schema.fields)
        where = f"{self.id_col} BETWEEN ? AND ?" + (f" AND ({self.where})" if self.where else "")
        fix = [float if isinstance(f.dataType, T.DoubleType) else str if isinstance(f.dataType, T.StringType) else None for f in self.schema.fields]
        with connect(self.path) as c:
            for row in c.execute(f"SELECT {names} FROM {self.table} WHERE {where} ORDER BY {self.id_col}", (part.low, part.high)):
                yield tuple(v if v is None or k is None else k(v) for v, k in zip(row, fix, strict=True))


class SqliteWriter(DataSourceWriter):
    """Tasks write their rows to files beside the database; the commit applies all of them in one transaction, or none."""

    def __init__(self, options, schema: T.StructType):
        self.path, self.table, self.id_col = options["path"], identifier(options["table"]), identifier(options.get("id_col", "id"))
        self.columns = [identifier(f.name) for f in schema.fields]
        if self.id_col not in self.columns:
            raise ValueError(f"results need {self.id_col}")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        folder = Path(self.path).resolve().parent
        with tempfile.NamedTemporaryFile("wb", dir=folder, prefix=".staged-", delete=False) as f:
            for row in rows:
                pickle.dump(tuple(row), f)
        return Staged(f.name)

    def commit(self, messages: list) -> None:
        others = [c for c in self.columns if c != self.id_col]
        places = [self.columns.index(c) for c in [*others, self.id_col]]
        sql = f"UPDATE {self.table} SET {', '.join(f'{c} = ?' for c in others)} WHERE {self.id_col} = ?"
        c = connect(self.path)
        try:
            with c:
                for m in messages:
                    if m is not None:
                        c.executemany(sql, self._rows(m.path, places))
        finally:
            c.close()
            self._clear(messages)

    def abort(self, messages: list) -> None:
        self._clear(messages)

    @staticmethod
    def _rows(path: str, places: list[int]) -> Iterator[tuple]:
        with open(path, "rb") as f:
            while True:
                try:
                    row = pickle.load(f)  # noqa: S301  our own file
                except EOFError:
                    return
                yield tuple(row[k] for k in places)

    @staticmethod
    def _clear(messages: list) -> None:
        for m in messages:
            if m is not None:
                Path(m.path).unlink(missing_ok=True)


def pending(spark: SparkSession, path: str, table: str, spec: TaskSpec, partitions: int = 8) -> DataFrame:
    """Unprocessed rows, selected by the store, with id and inputs."""
    df = spark.read.format("sqlite_table").options(path=path, table=table, id_col=spec.id_col, partitions=str(partitions), where=unprocessed_sql(spec)).load()
    return df.select(spec.id_col, *[c for c in spec.inputs if c != spec.id_col])
