"""Stores with ids that are spread unevenly, and JDBC against the embedded database that comes with Spark."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from tablemill.plans.spec import TaskSpec
from tablemill.sources import jdbc, open_source
from tablemill.sources.sqlite import SqliteReader, SqliteSource

#: A thousand ids in a row and one far away.
IDS = [*range(1, 1001), 10**12]
SPEC = TaskSpec(("question",), {"answer": "answer"})


def sizes(df):
    return sorted(r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect())


def test_sqlite_parts_have_equally_many_rows(spark, tmp_path):
    path = f"{tmp_path}/t.db"
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE tasks (id INTEGER PRIMARY KEY, question TEXT, answer TEXT)")
        c.executemany("INSERT INTO tasks VALUES (?, ?, NULL)", [(i, f"q{i}") for i in IDS])
        c.execute("CREATE TABLE odd (id, question TEXT)")
        c.executemany("INSERT INTO odd VALUES (?, 'q')", [(1,), (1,), (1,), (5,), (None,)])
    df = open_source(spark, {"type": "sqlite", "db_path": path, "table_name": "tasks"})
    assert sorted(r.id for r in df.collect()) == IDS
    assert len(sizes(df)) == 8 and max(sizes(df)) <= 126
    reader = SqliteReader({"path": path, "table": "odd", "partitions": "4"}, SqliteSource({"path": path, "table": "odd"}).schema())
    parts = reader.partitions()
    assert [(p.low, p.high) for p in parts] == [(1, 4), (5, 5)] and [len(list(reader.read(p))) for p in parts] == [3, 1]
    with sqlite3.connect(path) as c:
        c.execute("INSERT INTO odd VALUES ('x', 'q')")
    with pytest.raises(ValueError):
        reader.partitions()


@pytest.fixture(scope="module")
def derby(spark, tmp_path_factory):
    options = {"url": f"jdbc:derby:{tmp_path_factory.mktemp('derby')}/db;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "dbtable": "tasks"}
    jdbc.run_statements(spark, options, ['CREATE TABLE tasks ("id" BIGINT, "question" VARCHAR(100), "answer" CLOB)'])  # nulls of text go to this store as CLOB
    rows = spark.createDataFrame([(i, f"q{i % 10}", "old" if i % 4 == 0 else None) for i in IDS] + [(None, "no id", None)], "id bigint, question string, answer string")
    rows.write.format("jdbc").options(**options).mode("append").save()
    return options


def test_jdbc_parts_have_equally_many_rows(spark, derby):
    df = jdbc.read_in_parts(spark, derby, "id", 8)
    assert sorted(r.id for r in df.collect() if r.id is not None) == IDS and df.where("id is null").count() == 1
    n = sizes(df)
    assert len(n) == 8 and max(n) <= 130 and min(n) >= 120
    plan = df.where("question = 'q3'").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(question), *EqualTo(question,q3)]" in plan and "ReadSchema: struct<id:bigint>" in plan
    assert jdbc.table(spark, derby, {"partitions": 3}).rdd.getNumPartitions() == 3
    bounded = jdbc.table(spark, {**derby, "partitionColumn": "id", "lowerBound": "0", "upperBound": "1000", "numPartitions": "2"}, {})
    assert bounded.rdd.getNumPartitions() == 2 and bounded.count() == len(IDS) + 1


def test_jdbc_of_an_empty_table(spark, derby):
    options = {**derby, "dbtable": "nothing"}
    jdbc.run_statements(spark, options, ['CREATE TABLE nothing ("id" BIGINT, "question" VARCHAR(10))'])
    assert jdbc.ranges(spark, options, "id") == ["1 = 1"] and jdbc.read_in_parts(spark, options, "id").count() == 0


def test_results_are_merged_in_one_transaction(spark, derby):
    results = spark.createDataFrame([(3, "three"), (4, None), (5, "five"), (-1, "nobody")], "id bigint, answer string")
    jdbc.write_results(results, derby, "staged")
    statements = jdbc.update_statements("tasks", "staged", SPEC, "standard")
    with pytest.raises(Exception, match="(?i)syntax"):
        jdbc.run_statements(spark, derby, [statements[0], "not a statement"])
    answers = lambda: {r.id: r.answer for r in jdbc.read(spark, derby).where("id in (3, 4, 5, -1, 8)").collect()}
    assert answers() == {3: None, 4: "old", 5: None, 8: "old"}  # nothing of a transaction that failed
    jdbc.run_statements(spark, derby, statements)
    assert answers() == {3: "three", 4: "old", 5: "five", 8: "old"}
    with pytest.raises(Exception, match="(?i)staged"):
        jdbc.read(spark, {**derby, "dbtable": "staged"})
