"""File sources and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {".csv": "csv", ".xlsx": "xlsx", ".xlsm": "xlsx", ".parquet": "parquet", ".json": "json", ".jsonl": "json", ".orc": "orc"}
#: Cells with line ends and doubled quotes, as spreadsheets write them.
CSV = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"', "encoding": "UTF-8"}


def kind_of(path: str) -> str:
    """By suffix, in either case; anything else is a spreadsheet."""
    return next((k for s, k in _KINDS.items() if path.lower().rstrip("/").endswith(s)), "xlsx")


def read(spark: SparkSession, path: str, kind: str | None = None, options: Mapping | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """A table from files. CSV types are inferred unless a schema is given, which spares a pass over the data.

    A CSV file is read by one task, as cells may hold line ends; with the option ``multiLine`` false it is split.
    """
    kind = kind or kind_of(path)
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.options(**CSV | ({} if schema is not None else {"inferSchema": "true"}))
    reader = reader.options(**{k: str(v) for k, v in (options or {}).items()})
    if kind == "xlsx" and schema is None:
        schema = _spreadsheet_types(spark.read.format("xlsx").options(**{k: str(v) for k, v in (options or {}).items()}).option("kinds", "true").load(path))
    return (reader.schema(schema) if schema is not None else reader).load(path)


def _spreadsheet_types(cells: DataFrame) -> T.StructType:
    """Types by what all cells are: of one kind, or text. ``cells`` has a letter for its kind before each cell's text."""
    whole = lambda c: F.substring(c, 2, 400).try_cast("double") == F.floor(F.substring(c, 2, 400).try_cast("double"))
    seen = [F.struct(F.collect_set(F.substring(c, 1, 1)).alias("kinds"), F.bool_and(whole(c)).alias("whole")).alias(str(k)) for k, c in enumerate(F.col(f"`{n}`") for n in cells.columns)]
    found = cells.agg(*seen).first() if seen else []
    kind = lambda said: T.BooleanType() if said["kinds"] == ["b"] else T.StringType() if said["kinds"] != ["n"] else T.LongType() if said["whole"] else T.DoubleType()
    return T.StructType([T.StructField(n, kind(said)) for n, said in zip(cells.columns, found, strict=True)])


def complete(spark: SparkSession, path: str) -> bool:
    """Whether Spark has written a table here to its end."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def with_row_ids(df: DataFrame, name: str = "_row_id") -> DataFrame:
    """Dense row numbers from 0 in file order, for tables without a key.

    Parquet tells each row's place in its file; other formats are numbered by partition in reading order, which has to be
    the same each time they are read. Either way only counts per file or partition are ordered together, never rows.
    """
    from pyspark.errors import AnalysisException
    from pyspark.sql import Window

    try:
        placed = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i"))
    except AnalysisException:  # the source has no such metadata
        made = df.withColumn("_m", F.monotonically_increasing_id())  # the partition above 33 bits of a count
        placed = made.select(*[F.col(f"`{c}`") for c in df.columns], F.shiftright("_m", 33).alias("_f"), F.col("_m").bitwiseAND((1 << 33) - 1).alias("_i"))
    counts = placed.groupBy("_f").agg(F.max("_i").alias("_n"))
    before = Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_f").alias("_file"), F.coalesce(F.sum(F.col("_n") + 1).over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), F.col("_f") == F.col("_file")).withColumn(name, F.col("_start") + F.col("_i")).drop("_f", "_i", "_file", "_start")


def clean_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text columns with invalid UTF-8 replaced, so that any sink can encode them."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    return df.withColumns({n: F.make_valid_utf8(F.col(f"`{n}`")) for n in names}) if names else df


def _flat(df: DataFrame) -> list[Column]:
    return [F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`") for f in df.schema.fields]


def write(df: DataFrame, path: str, kind: str | None = None, single: bool = False) -> None:
    """Write a table, also over the files that it is read from: it goes to a folder beside them first, and is then moved.

    ``single`` makes one part file, through one task. Nested columns become JSON in CSV.
    """
    kind = kind or kind_of(path)
    spark = df.sparkSession
    if kind == "xlsx":
        from tablemill.sources.xlsx import XlsxSource

        spark.dataSource.register(XlsxSource)
        df.write.format("xlsx").mode("overwrite").option("path", path).save()
        return
    out = clean_text(df)
    out = out.select(*_flat(out)) if kind == "csv" else out
    out = out.coalesce(1) if single else out
    beside = f"{path.rstrip('/')}._staged-{uuid.uuid4().hex}"
    writer = out.write.format(kind)
    (writer.options(header="true", escape='"', quote='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false") if kind == "csv" else writer).save(beside)
    jvm = spark.sparkContext._jvm
    target, staged = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(beside)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}._old-{uuid.uuid4().hex}")
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"can't replace {path}")
    if not fs.rename(staged, target):
        fs.rename(old, target)
        raise OSError(f"can't move {beside} to {path}")
    fs.delete(old, True)
