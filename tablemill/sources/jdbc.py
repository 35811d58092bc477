"""SQL stores by JDBC: ranges of ids are read in parallel, filters and counts go to the store, results come back as updates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.operators.predicates import unprocessed_sql
from tablemill.plans.spec import TaskSpec, identifier


def _options(o: Mapping, url: str, driver: str, table: str) -> dict[str, str]:
    out = {"url": url, "driver": driver, "dbtable": table, "user": str(o.get("user", "")), "password": str(o.get("password", "")), "fetchsize": str(o.get("fetch_size", 1000)), "batchsize": str(o.get("batch_size", 100)), "pushDownAggregate": "true", "pushDownLimit": "true"}
    if o.get("lower") is not None and o.get("upper") is not None:
        out |= {"partitionColumn": identifier(o.get("id_col", "id")), "lowerBound": str(o["lower"]), "upperBound": str(o["upper"]), "numPartitions": str(o.get("partitions", 8))}
    return out


def mysql(o: Mapping[str, Any]) -> dict[str, str]:
    table = "`" + str(o["table_name"]).replace("`", "``") + "`"
    return _options(o, f"jdbc:mysql://{o['host']}:{o.get('port', 3306)}/{o['database']}", o.get("driver", "com.mysql.cj.jdbc.Driver"), table)


def postgresql(o: Mapping[str, Any]) -> dict[str, str]:
    table = f"{identifier(o.get('schema_name', 'public'))}.{identifier(o['table_name'])}"
    return _options(o, f"jdbc:postgresql://{o['host']}:{o.get('port', 5432)}/{o['database']}?connectTimeout=10", o.get("driver", "org.postgresql.Driver"), table) | {"queryTimeout": "30"}


def read(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()


def ranges(spark: SparkSession, options: Mapping[str, str], id_col: str, partitions: int = 8) -> list[str]:
    """Conditions that cut the table into parts of about equally many rows, by quantiles of its ids; rows without an id are in the first.

    The store is asked for its ids once, by one connection; Spark makes the quantiles. Bounds of equal width would leave most rows in
    one part where ids are spread unevenly.
    """
    q = _quoted(options, id_col)
    ids = read(spark, {k: v for k, v in options.items() if k != "partitionColumn"} | {"dbtable": f"(SELECT {q} AS {_quoted(options, 'split_id')} FROM {options['dbtable']}) ids"})
    at = [k / partitions for k in range(1, partitions)]
    found = ids.agg(F.percentile_approx("split_id", at, 10_000).alias("q")).first()["q"] if at else None
    cuts = sorted({int(v) for v in found or []})
    if not cuts:
        return ["1 = 1"]
    inner = [f"{q} > {a} AND {q} <= {b}" for a, b in zip(cuts, cuts[1:], strict=False)]
    return [f"{q} <= {cuts[0]} OR {q} IS NULL", *inner, f"{q} > {cuts[-1]}"]


def read_in_parts(spark: SparkSession, options: Mapping[str, str], id_col: str, partitions: int = 8) -> DataFrame:
    """The table through as many connections as ``ranges`` gives parts; Spark pushes filters and columns to each."""
    known = {k: v for k, v in options.items() if k not in ("url", "dbtable", "partitionColumn", "lowerBound", "upperBound", "numPartitions")}
    return spark.read.jdbc(options["url"], options["dbtable"], predicates=ranges(spark, options, id_col, partitions), properties=known)


def table(spark: SparkSession, options: Mapping[str, str], o: Mapping[str, Any]) -> DataFrame:
    """The configured table: by the given bounds, or cut by its ids where there are none."""
    if "partitionColumn" in options:
        return read(spark, options)
    return read_in_parts(spark, options, o.get("id_col", "id"), int(o.get("partitions", 8)))


def _quoted(options: Mapping[str, str], column: str) -> str:
    """A column as the store quotes it, which keeps its case."""
    mark = "`" if options["url"].startswith("jdbc:mysql:") else '"'
    return f"{mark}{identifier(column)}{mark}"


def pending(spark: SparkSession, options: Mapping[str, str], spec: TaskSpec) -> DataFrame:
    """Unprocessed rows with id and inputs, selected by the store."""
    columns = ", ".join(map(identifier, [spec.id_col, *spec.inputs]))
    query = f"(SELECT {columns} FROM {options['dbtable']} WHERE {unprocessed_sql(spec)}) pending"
    return read(spark, {**options, "dbtable": query})


def update_statements(table: str, staging: str, spec: TaskSpec, dialect: str) -> list[str]:
    """SQL that moves results from a staging table, which Spark has written, into the task table in one transaction."""
    key, cols = identifier(spec.id_col), [identifier(c) for c in spec.output_columns]
    if dialect == "postgresql":
        return [f"UPDATE {table} t SET {', '.join(f'{c} = COALESCE(s.{c}, t.{c})' for c in cols)} FROM {staging} s WHERE t.{key} = s.{key}", f"DROP TABLE {staging}"]
    if dialect == "mysql":
        return [f"UPDATE {table} t JOIN {staging} s ON t.{key} = s.{key} SET {', '.join(f't.{c} = COALESCE(s.{c}, t.{c})' for c in cols)}", f"DROP TABLE {staging}"]
    if dialect == "standard":
        quoted = lambda c: f'"{c}"'  # noqa: E731  as Spark names the columns that it makes
        sets = ", ".join(f"{quoted(c)} = COALESCE(s.{quoted(c)}, t.{quoted(c)})" for c in cols)
        return [f"MERGE INTO {table} t USING {staging} s ON t.{quoted(key)} = s.{quoted(key)} WHEN MATCHED THEN UPDATE SET {sets}", f"DROP TABLE {staging}"]
    raise ValueError(f"unknown dialect: {dialect}")


def write_results(results: DataFrame, options: Mapping[str, str], staging: str) -> None:
    """Results into a new staging table, in parallel and in batches."""
    results.write.format("jdbc").options(**{**options, "dbtable": staging}).mode("overwrite").save()


def run_statements(spark: SparkSession, options: Mapping[str, str], statements: Sequence[str]) -> None:
    """Statements in one transaction, over the driver's own JDBC connection."""
    jvm = spark.sparkContext._jvm
    jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
    connection = jvm.java.sql.DriverManager.getConnection(options["url"], options.get("user", ""), options.get("password", ""))
    try:
        connection.setAutoCommit(False)
        for s in statements:
            connection.createStatement().execute(s)
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()
