import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tablemill.operators.merge import write_back
from tablemill.operators.predicates import processed, unprocessed
from tablemill.operators.sharding import bounds
from tablemill.plans.spec import TaskSpec
from tablemill.sources import capabilities, files, jdbc, open_source, register_all, rest, xlsx
from tablemill.sources.registry import OPENERS, register
from tablemill.sources.sqlite import pending as sqlite_pending


def counted(df, spec):
    return df.filter(unprocessed(df, spec)).count(), df.filter(processed(df, spec)).count()


def test_csv(spark, tmp_path):
    p = tmp_path / "in.CSV"
    p.write_text('id,input_text,output\n1,"a, ""b""\nnext",\n2,漢字 한글,done\n3,,\n', encoding="utf-8")
    df = open_source(spark, {"type": "csv", "input_path": str(p)})
    assert {r.id: r.input_text for r in df.collect()} == {1: 'a, "b"\nnext', 2: "漢字 한글", 3: None}
    assert counted(df, TaskSpec(("input_text",), {"o": "output"})) == (1, 1)
    files.write(df.withColumn("l", F.array(F.lit(1))), str(tmp_path / "out.csv"), single=True)
    back = files.read(spark, str(tmp_path / "out.csv"))
    assert back.count() == 3 and back.where("id = 1").first().input_text == 'a, "b"\nnext' and back.first().l == "[1]"
    assert files.read(spark, str(p), schema="id int, input_text string, output string").count() == 3


def test_a_table_can_be_written_over_itself(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10).withColumn("v", F.lit("a")).write.parquet(path)
    df = files.read(spark, path)
    files.write(df.withColumn("v", F.lit("b")), path)
    spark.catalog.refreshByPath(path)
    assert [r.v for r in files.read(spark, path).distinct().select("v").distinct().collect()] == ["b"]
    assert sorted(x.name for x in tmp_path.iterdir()) == ["t.parquet"]


def test_row_ids(spark, tmp_path):
    spark.range(1000).repartition(3).write.parquet(str(tmp_path / "p"))
    for df in (spark.read.parquet(str(tmp_path / "p")), spark.createDataFrame([(i,) for i in range(50)], "id int")):
        got = sorted(r._row_id for r in files.with_row_ids(df).collect())
        assert got == list(range(len(got)))


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE tasks (id INTEGER PRIMARY KEY, input_text TEXT, context TEXT, output_result TEXT, output_summary TEXT, score REAL)")
        c.executemany("INSERT INTO tasks VALUES (?, ?, ?, ?, ?, ?)", [(1, "a", "c", None, None, 1), (2, "b", "c", "", None, 2.5), (3, "d", "c", "done", "done", None), (4, "", "c", None, None, 0), (5, "e", None, None, None, 0)])
    return path


SQL_SPEC = TaskSpec(("input_text", "context"), {"result": "output_result", "summary": "output_summary"}, mode="sql")


def test_sqlite(spark, database):
    df = open_source(spark, {"type": "sqlite", "db_path": database, "table_name": "tasks", "partitions": 3})
    assert df.count() == 5 and counted(df, SQL_SPEC) == (2, 1) and tuple(bounds(df, "id").first())[:2] == (1, 5)
    assert df.where("id >= 2 and id < 4 and score is not null").select("id", "score").collect() == [(2, 2.5)]
    assert sorted(r.id for r in sqlite_pending(spark, database, "tasks", SQL_SPEC).collect()) == [1, 2] and df.count() == 5
    any_ = TaskSpec(("input_text", "context"), {"r": "output_result"}, require_all=False, mode="sql")
    assert counted(df, any_) == (4, 1)
    results = spark.createDataFrame([(1, "new", None), (2, "other", "sum"), (9, "lost", None)], "id int, output_result string, output_summary string")
    results.write.format("sqlite_table").options(path=database, table="tasks").mode("append").save()
    with sqlite3.connect(database) as c:
        assert c.execute("SELECT id, output_result, output_summary FROM tasks WHERE id < 4").fetchall() == [(1, "new", None), (2, "other", "sum"), (3, "done", "done")]


def test_sqlite_errors(spark, database, tmp_path):
    for options in ({"db_path": database, "table_name": "gone"}, {"db_path": str(tmp_path / "no.db"), "table_name": "tasks"}, {"db_path": database, "table_name": "a b"}):
        with pytest.raises(Exception):  # noqa: B017, PT011
            open_source(spark, {"type": "sqlite", **options}).count()
    with pytest.raises(ValueError, match="missing"):
        open_source(spark, {"type": "sqlite", "db_path": database})


def test_sqlite_write_is_all_or_nothing(spark, database):
    register_all(spark)
    bad = spark.range(1, 4).select("id", F.when(F.col("id") == 3, F.raise_error(F.lit("boom"))).otherwise(F.lit("x")).alias("output_result"))
    with pytest.raises(Exception, match="boom"):
        bad.write.format("sqlite_table").options(path=database, table="tasks").mode("append").save()
    with sqlite3.connect(database) as c:
        assert c.execute("SELECT count(*) FROM tasks WHERE output_result = 'x'").fetchone() == (0,)


def test_xlsx(spark, tmp_path):
    path = str(tmp_path / "t.xlsx")
    df = spark.createDataFrame([(1, "a <b> & \"c\"\nnext \x07", 1.5, True, None), (2, None, 2.0, False, "é漢")], "id int, text string, n double, flag boolean, out string")
    files.write(df, path)
    back = open_source(spark, {"type": "excel", "input_path": path})
    assert back.dtypes == [("id", "bigint"), ("text", "string"), ("n", "double"), ("flag", "boolean"), ("out", "string")]
    assert [tuple(r) for r in back.orderBy("id").collect()] == [(1, 'a <b> & "c"\nnext ', 1.5, True, None), (2, None, 2.0, False, "é漢")]
    spec = TaskSpec(("text",), {"out": "out"})
    assert counted(back, spec) == (1, 1)
    merged = write_back(back, spark.createDataFrame([(1, "done")], "id bigint, out string"), spec)
    files.write(merged, path)  # over the file that is read
    assert counted(open_source(spark, {"type": "xlsx", "input_path": path, "sheet": "Sheet1"}), spec) == (0, 2)
    with pytest.raises(Exception, match="no sheet"):
        open_source(spark, {"type": "xlsx", "input_path": path, "sheet": "Other"})
    with pytest.raises(Exception, match="no sheet"):
        open_source(spark, {"type": "xlsx", "input_path": path, "sheet": 3})


def test_column_letters():
    for k, name in {0: "A", 1: "B", 25: "Z", 26: "AA", 27: "AB", 51: "AZ", 52: "BA", 701: "ZZ", 702: "AAA"}.items():
        assert xlsx.letters(k) == name and xlsx.column_of(f"{name}9") == k
    assert rest.parse_range("s1!A1:AB9") == ("s1", "A", 1, "AB", 9)
    with pytest.raises(ValueError):
        rest.parse_range("A1")


RECORDS = [{"record_id": f"r{k}", "fields": {"question": q, "context": c, "ai_answer": a}} for k, (q, c, a) in enumerate([("Q1", [{"text": "C"}, {"name": "D"}], None), ("Q2", {"text": "link", "link": "u"}, None), ("Q3", 42, "done")])]


def test_record_tables(spark, tmp_path):
    store = tmp_path / "s.json"
    store.write_text(json.dumps({"fields": ["question", "context", "ai_answer"], "records": RECORDS}))
    options = {"type": "bitable", "transport": "fake_rest:transport", "store": str(store), "app_token": "a", "table_id": "t", "busy": "1", "most": 1}
    df = open_source(spark, options)
    assert {r.record_id: (r._row_id, r.context) for r in df.collect()} == {"r0": (0, "C, D"), "r1": (1, "link"), "r2": (2, "42")}
    assert counted(df, TaskSpec(("question", "context"), {"a": "ai_answer"}, "_row_id")) == (2, 1)
    results = spark.createDataFrame([("r0", "A0"), ("r1", None), (None, "made")], "record_id string, ai_answer string").coalesce(1)
    results.write.format("rest_table").options(kind="bitable", **{k: str(v) for k, v in options.items() if k != "type"}).mode("append").save()
    assert [r["fields"]["ai_answer"] for r in json.loads(store.read_text())["records"]] == ["A0", None, "done", "made"]


def test_sheets(spark, tmp_path):
    store = tmp_path / "s.json"
    store.write_text(json.dumps({"cells": [["question", "ai_answer"], ["Q1"], ["Q2", ""], ["Q3", "done"], ["Q4", None]]}))
    options = {"transport": "fake_rest:transport", "store": str(store), "spreadsheet_token": "a", "sheet_id": "t", "most": 2}
    df = open_source(spark, {"type": "sheet", **options})
    spec = TaskSpec(("question",), {"a": "ai_answer"}, "_row_id")
    assert [tuple(r) for r in df.orderBy("_row_id").collect()] == [(0, "Q1", ""), (1, "Q2", ""), (2, "Q3", "done"), (3, "Q4", "")] and counted(df, spec) == (3, 1)
    results = spark.createDataFrame([(0, "A"), (1, "B"), (3, "D")], "_row_id bigint, ai_answer string").coalesce(1)
    results.write.format("rest_table").options(kind="sheet", **{k: str(v) for k, v in options.items()}).mode("append").save()
    said = json.loads(store.read_text())
    assert [r[1] for r in said["cells"]] == ["ai_answer", "A", "B", "done", "D"] and said["writes"] == ["t!B2:B3", "t!B5:B5"]


def test_patience_and_halves():
    slept, left = [], [rest.Busy(), rest.Busy(7.0), rest.Expired()]

    def call(*_):
        if left:
            raise left.pop(0)
        return {"ok": 1}

    renewed = []
    assert rest.patient(call, lambda: renewed.append(1), sleep=slept.append)("GET", "x") == {"ok": 1} and slept == [1.0, 7.0] and renewed == [1]

    def send(part):
        if len(part) > 3:
            raise rest.TooLarge
        return list(part)

    assert rest.in_halves(range(10), send) == [[0, 1], [2, 3, 4], [5, 6], [7, 8, 9]]
    with pytest.raises(rest.TooLarge):
        rest.in_halves([1], lambda p: (_ for _ in ()).throw(rest.TooLarge))
    assert rest.row_ranges([5, 1, 2, 3, 3]) == [(1, 3), (5, 5)]
    assert [rest.plain(v) for v in (None, "t", 42, 3.14, [{"text": "A"}, {"text": "B"}], {"link": "l"})] == ["", "t", "42", "3.14", "A, B", "l"]


def test_jdbc_options_and_statements():
    o = {"host": "h", "database": "d", "table_name": "t", "user": "u", "password": "p", "lower": 0, "upper": 99}
    assert jdbc.mysql({**o, "table_name": "a`b"})["dbtable"] == "`a``b`" and jdbc.mysql(o)["url"] == "jdbc:mysql://h:3306/d"
    pg = jdbc.postgresql(o)
    assert pg["dbtable"] == "public.t" and pg["partitionColumn"] == "id" and pg["queryTimeout"] == "30"
    spec = TaskSpec(("q",), {"a": "x", "b": "y"})
    assert jdbc.update_statements("t", "s", spec, "postgresql")[0] == "UPDATE t t SET x = COALESCE(s.x, t.x), y = COALESCE(s.y, t.y) FROM s s WHERE t.id = s.id"
    assert "JOIN s s ON" in jdbc.update_statements("t", "s", spec, "mysql")[0]
    with pytest.raises(ValueError):
        jdbc.update_statements("t", "s", spec, "other")


def test_registry(spark):
    register("mine", lambda s, o: s.range(int(o["n"])))
    assert open_source(spark, {"type": "mine", "n": 3}).count() == 3 and set(capabilities()) >= {"pyarrow"}
    del OPENERS["mine"]
    with pytest.raises(ValueError, match="unknown"):
        open_source(spark, {"type": "gone"})
    with pytest.raises(ValueError, match="missing"):
        open_source(spark, {"type": "csv"})
    assert [files.kind_of(p) for p in ("a.csv", "B.CSV", "c.xlsx", "d", "e.parquet/")] == ["csv", "csv", "xlsx", "xlsx", "parquet"]


def test_row_ids_of_a_format_without_row_places(spark, tmp_path):
    spark.range(1000, numPartitions=4).selectExpr("concat('r', id) AS t").write.text(f"{tmp_path}/t")
    rows = files.with_row_ids(spark.read.text(f"{tmp_path}/t")).collect()
    assert sorted(r._row_id for r in rows) == list(range(1000)) and rows[0].value.startswith("r")


def workbook(path, sheet, shared=None):
    import zipfile

    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        if shared:
            z.writestr("xl/sharedStrings.xml", shared)


def test_spreadsheets_of_other_programs(spark, tmp_path):
    """Shared strings with runs and phonetic text, prefixes, gaps, entities, CDATA, empty rows; cut anywhere, the rows are the same."""
    main = 'xmlns:x="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared = f'<x:sst {main}><x:si><x:t>name</x:t></x:si><x:si><x:r><x:t>a </x:t></x:r><x:r><x:rPr/><x:t xml:space="preserve">&amp;lt; b</x:t></x:r><x:rPh><x:t>no</x:t></x:rPh></x:si><x:si/></x:sst>'
    rows = '<x:row r="1"><x:c r="A1" t="s"><x:v>0</x:v></x:c><x:c r="C1" t="inlineStr"><x:is><x:t>flag</x:t></x:is></x:c><x:c r="D1" t="str"><x:f>1</x:f><x:v>n</x:v></x:c></x:row>'
    rows += '<x:row r="2"><x:c r="A2" t="s"><x:v>1</x:v></x:c><x:c r="C2" t="b"><x:v>1</x:v></x:c><x:c r="D2"><x:v>2</x:v></x:c></x:row><x:row r="3"/>'
    rows += '<x:row r="4"><x:c r="A4" t="inlineStr"><x:is><x:t><![CDATA[<i>&]]> x&#233;\r\ny</x:t></x:is></x:c><x:c r="B4"/><x:c r="D4" s="1"><x:v>1E2</x:v></x:c></x:row>'
    rows += "".join(f'<x:row r="{k}"><x:c r="A{k}" t="s"><x:v>{k % 3}</x:v></x:c><x:c r="D{k}"><x:v>{k}</x:v></x:c></x:row>' for k in range(5, 60))
    path = str(tmp_path / "other.xlsx")
    workbook(path, f'<?xml version="1.0"?><x:worksheet {main}><x:cols/><x:sheetData>{rows}</x:sheetData><x:rowBreaks count="1"/></x:worksheet>', shared)
    whole = list(xlsx.sheet_rows(path))
    assert whole[0] == ["name", None, "flag", "n"] and whole[1] == ["a &lt; b", None, True, 2.0] and whole[2] == [] and whole[3] == ["<i>& x\u00e9\ny", None, None, 100.0]
    assert len(whole) == 59 and [r[0] for r in whole[4:7]] == ["", "name", "a &lt; b"]
    size = xlsx.sheet_size(path)
    for n in (2, 7, 100):
        cuts = [size * k // n for k in range(n + 1)]
        assert [r for a, b in zip(cuts, cuts[1:], strict=False) for r in xlsx.sheet_rows(path, 0, a, b)] == whole
    df = files.read(spark, path, options={"part_bytes": 500})
    assert df.rdd.getNumPartitions() > 8 and [f.dataType.simpleString() for f in df.schema.fields] == ["string", "string", "boolean", "bigint"]
    got = df.collect()
    assert [tuple(r) for r in got[:3]] == [("a &lt; b", None, True, 2), (None, None, None, None), ("<i>& x\u00e9\ny", None, None, 100)] and len(got) == 58
    assert spark.read.format("xlsx").load(path).schema == df.schema


def test_large_spreadsheets_are_written_and_read_by_many_tasks(spark, tmp_path):
    import zipfile

    from pyspark.sql import functions as F

    path = str(tmp_path / "large.xlsx")
    rows = spark.range(0, 60_000, 1, 6).select("id", F.concat(F.lit("text <&> \u00e9 "), F.col("id").cast("string")).alias("t"), (F.col("id") / 4).alias("x"), F.when(F.col("id") % 3 == 0, F.col("id") % 2 == 0).alias("b"))
    files.write(rows, path)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.getinfo("xl/worksheets/sheet1.xml").file_size == len(z.read("xl/worksheets/sheet1.xml"))
    back = files.read(spark, path, options={"part_bytes": 1 << 20})
    assert back.rdd.getNumPartitions() > 4 and back.schema.simpleString() == "struct<id:bigint,t:string,x:double,b:boolean>"
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in rows.collect()]
    assert xlsx.crc_joined(0x12345678, 0, 0) == 0x12345678
