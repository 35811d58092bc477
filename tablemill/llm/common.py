"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.functions.batches import small_batches

#: A word is a maximal run of characters outside these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local master, whose executors are the driver, gets a temporary folder for the session where the setting is
    missing; on a cluster that is an error, as no folder of one machine would do.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='tablemill-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Cuts the lineage: a lost executor later costs a reread of files, not a recomputation. Unlike an RDD
    checkpoint, the rows are computed once and later readers prune columns.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(df: DataFrame, col: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(df[col].cast("string"), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` doesn't have."""
    out = []
    for name in names:
        while name in df.columns:
            name = f"_{name}"
        out.append(name)
    return out


def rows_that_stay(df: DataFrame, key: Column, judged: DataFrame) -> DataFrame:
    """The rows of ``df`` that stay, with all columns, by a key that equal rows share.

    ``judged`` has a row for each key: _place, _stays, _n (rows of that key). Of rows with a key that stays one stays. Only keys that go or
    have several rows are joined, so mostly a small table; rows that aren't named stay.
    """
    (place,) = fresh(df, "_at_place")
    named = staged(judged.where("not _stays or _n > 1").select(F.col("_place").alias(place), "_stays"), "judged")
    (stays,) = fresh(df, "_row_stays")
    marked = df.withColumn(place, key).join(named.withColumnRenamed("_stays", stays), place, "left")
    out = marked.where(F.col(stays).isNull())
    if not named.where("_stays").isEmpty():
        out = out.unionByName(marked.where(F.col(stays)).dropDuplicates([place]))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def place_of(id_col: Column, text: Column) -> Column:
    """A digest of id and text, never null: rows that share it are the same document."""
    return F.unhex(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), text)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(
    df: DataFrame, make: Callable[[], Callable[[str], tuple]], text_col: str, out: list[tuple[str, str, pa.DataType]], keep: list[str] | None = None, size: int = 512
) -> DataFrame:
    """Add columns computed from one text (or binary) column, by ``make()()`` per value, in Arrow batches.

    ``make`` runs once in each task. ``keep`` names the input columns that pass through (all by default); one that has
    the name of an output column is replaced. Values go through in slices of ``size`` rows, so memory follows the batch.
    """
    small_batches(df.sparkSession)
    names = {n for n, _, _ in out}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    read = kept if text_col in kept else [*kept, text_col]
    at = read.index(text_col)
    n_kept = len(kept)
    types = [(n, t) for n, _, t in out]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[f"`{c}`" for c in kept]).schema.fields] + [f"`{n}` {ddl}" for n, ddl, _ in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for whole in batches:
            for lo in range(0, whole.num_rows, size):
                part = whole.slice(lo, size)
                got = [one(v.as_py()) for v in part.column(at)]
                cols = [pa.array([g[k] for g in got], type=t) for k, (_, t) in enumerate(types)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n_kept)] + cols, names=kept + [n for n, _ in types])

    return df.select(*[f"`{c}`" for c in read]).mapInArrow(run, schema)
