
import pytest
from pyspark.sql import functions as F

from tablemill.functions.emptiness import is_empty, known_text, to_text
from tablemill.operators import columns, predicates
from tablemill.operators.stats import counts
from tablemill.plans.spec import TaskSpec

TASKS = [(1, "Q1", "C1", None), (2, "Q2", "C2", "A2"), (3, "", "C3", None), (4, None, "C4", None), (5, "Q5", "", None)]


@pytest.fixture(scope="module")
def tasks(spark):
    return spark.createDataFrame(TASKS, "id int, question string, context string, answer string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_blank_follows_unicode(spark):
    values = [" ", "\t\n", "　", "\xa0", "\x1c", "\x85", "​", "x", None, "", "0"]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v string")
    got = {r.k: (r.blank, r.sql) for r in df.select("k", is_empty(df, "v").alias("blank"), is_empty(df, "v", "sql").alias("sql")).collect()}
    for k, v in enumerate(values):
        assert got[k] == (v is None or not v.strip(), v is None or v == ""), repr(v)


def test_numbers_and_nested_values(spark):
    df = spark.createDataFrame([(float("nan"), 0, False, [], {"a": 1}), (None, None, None, None, None), (0.0, 1, True, ["a"], {})], "f double, i int, b boolean, a array<string>, m map<string,int>")
    rows = df.select(*[is_empty(df, c).alias(c) for c in df.columns], is_empty(df, "gone").alias("gone")).collect()
    assert [tuple(r) for r in rows] == [(True, False, False, True, False, True), (True,) * 6, (False, False, False, False, True, True)]
    with pytest.raises(ValueError):
        is_empty(df, "f", "other")


def test_cells_as_text(spark):
    df = spark.createDataFrame([(None, 42, 3.14, [("A",), ("B",)], ("shown", "url"), float("nan")), ("text", 0, 1.0, [], (None, "url"), 2.5)], "s string, i int, d double, l array<struct<text:string>>, r struct<text:string,link:string>, n double")
    rows = df.select(*[to_text(df, c).alias(c) for c in df.columns]).collect()
    assert tuple(rows[0]) == ("", "42", "3.14", "A, B", "shown", "") and tuple(rows[1]) == ("text", "0", "1.0", "", "url", "2.5")
    assert [r[0] for r in spark.createDataFrame([(" a ",), ("  ",), (None,)], "v string").select(known_text(F.col("v"))).collect()] == ["a", None, None]


def test_unprocessed_all_and_any(tasks):
    one = TaskSpec(("question",), {"answer": "answer"})
    assert ids(tasks.filter(predicates.unprocessed(tasks, one))) == [1, 5]
    both = TaskSpec(("question", "context"), {"answer": "answer"})
    assert ids(tasks.filter(predicates.unprocessed(tasks, both))) == [1]
    some = TaskSpec(("question", "context"), {"answer": "answer"}, require_all=False)
    assert ids(tasks.filter(predicates.unprocessed(tasks, some))) == [1, 3, 4, 5]
    assert ids(tasks.filter(predicates.processed(tasks, one))) == [2]
    assert tuple(counts(tasks, one).first()) == (5, 2, 1)


def test_columns_that_do_not_exist(tasks):
    gone = TaskSpec(("question", "gone"), {"answer": "answer"})
    assert ids(tasks.filter(predicates.unprocessed(tasks, gone))) == []
    assert ids(tasks.filter(predicates.unprocessed(tasks, TaskSpec(("question", "gone"), {"a": "answer"}, require_all=False)))) == [1, 5]
    assert ids(tasks.filter(predicates.unprocessed(tasks, TaskSpec(("question",), {"a": "answer", "b": "new"})))) == [1, 2, 5]
    with pytest.raises(ValueError):
        TaskSpec((), {"a": "answer"})
    with pytest.raises(ValueError):
        TaskSpec(("question",), {})


def test_every_row_has_one_status(tasks):
    spec = TaskSpec(("question",), {"answer": "answer"})
    assert {r.id: r.s for r in tasks.select("id", predicates.status(tasks, spec).alias("s")).collect()} == {1: "unprocessed", 2: "processed", 3: "invalid", 4: "invalid", 5: "unprocessed"}


@pytest.mark.parametrize(("op", "value", "want"), [("eq", "C1", [1]), ("ne", "C1", [2, 3, 4, 5]), ("gt", "C3", [4]), ("lt", "C2", [1, 5]), ("ge", "C3", [3, 4]), ("le", "C1", [1, 5]), ("empty", None, [5]), ("not_empty", None, [1, 2, 3, 4])])
def test_conditions(tasks, op, value, want):
    assert ids(predicates.filter_ids(tasks, "id", "context", op, value)) == want


def test_conditions_on_nulls_and_unknown_names(tasks):
    assert ids(predicates.filter_ids(tasks, "id", "question", "ne", "Q1")) == [2, 3, 5]
    assert ids(predicates.filter_ids(tasks, "id", "question", "ne", "Q1", null_safe=True)) == [2, 3, 4, 5]
    assert ids(predicates.filter_ids(tasks, "id", "gone", "whatever")) == []
    with pytest.raises(ValueError):
        predicates.condition(tasks, "question", "whatever")


def test_sql_predicates_agree(spark, tasks):
    spec = TaskSpec(("question", "context"), {"answer": "answer"}, mode="sql")
    assert ids(tasks.filter(predicates.unprocessed_sql(spec))) == ids(tasks.filter(predicates.unprocessed(tasks, spec))) == [1]
    assert ids(tasks.filter(predicates.processed_sql(spec))) == [2]
    with pytest.raises(ValueError):
        predicates.unprocessed_sql(TaskSpec(("a; DROP TABLE t",), {"x": "y"}))


def test_rows_by_id(tasks):
    assert predicates.row_at(tasks, "id", 2).answer == "A2"
    with pytest.raises(IndexError):
        predicates.row_at(tasks, "id", 99)
    assert [r.id for r in predicates.rows_at(tasks, "id", [5, 99, 1]).collect()] == [5, 1]
    assert predicates.rows_at(tasks, "id", []).count() == 0
    spec = TaskSpec(("question",), {"answer": "answer"})
    assert [r.id for r in predicates.sample_rows(tasks, spec, 1).collect()] == [1]
    assert [tuple(r) for r in predicates.sample_rows(tasks, spec, 5, done=True).collect()] == [(2, "A2")]


def test_column_operations(tasks):
    assert columns.add_column(tasks, "answer", "x").first().answer is None and columns.add_column(tasks, "new", 7).first().new == 7
    assert columns.has_column(tasks, "id") and not columns.has_column(tasks, "gone")
    assert [r.asDict() for r in columns.rows(tasks.where("id = 1"), ["question", "gone"])] == [{"question": "Q1"}]
    assert columns.project(tasks, TaskSpec(("question", "gone"), {"a": "answer"}), as_text=True).where("id = 4").first().question == ""
    assert columns.to_physical(tasks.select("id", F.col("answer").alias("a")), {"a": "answer"}).columns == ["id", "answer"]
