import base64
import json
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablemill.functions import prompt, reply
from tablemill.operators import infer
from tablemill.operators.columns import with_outputs
from tablemill.plans import tokens
from tablemill.plans.enrich import Enrichment
from tablemill.plans.spec import TaskSpec, configured, deep_merge, identifier, token_mode


def test_prompts(spark):
    df = spark.createDataFrame([("Test", "ok", 5, None)], "name string, status string, _internal int, empty string")
    record = prompt.record_json(df, ["name", "status", "_internal", "empty", "gone"], exclude=["status"])
    row = df.select(prompt.render("A {record_json} B {record_json} $1", record).alias("p"), prompt.render("", record).alias("e"), prompt.messages_text(F.lit("SYS"), F.lit("USR")).alias("m"), prompt.messages_text(F.lit(""), F.lit("USR")).alias("n"), prompt.messages(F.lit(""), F.lit("u")).alias("one"), prompt.messages(F.lit("s"), F.lit("u")).alias("two")).first()
    assert row.p == 'A {"name":"Test"} B {"name":"Test"} $1' and row.e == "" and (row.m, row.n) == ("SYS\nUSR", "USR")
    assert [m.role for m in row.one] == ["user"] and [m.role for m in row.two] == ["system", "user"]
    assert df.select(prompt.output_json(df, {"a": "name", "b": "empty", "c": "gone"})).first()[0] == '{"a":"Test","c":""}'
    assert df.select(prompt.stop_list(F.col("name"), False)).first()[0] == ["Test"]


RULES = {"status": ["ok", "bad"]}


@pytest.mark.parametrize(
    ("text", "data", "error"),
    [
        ('{"name":"a","status":"ok"}', {"name": "a", "status": "ok"}, None),
        ('Sure:\n```json\n{"name":"a","status":"ok",}\n```\nbye', {"name": "a", "status": "ok"}, None),
        ('```JSON {"name":{"x":1},"status":"ok"} ```', {"name": {"x": 1}, "status": "ok"}, None),
        ('I say {"name":"a","status":"ok"} and {"b":1}', {"name": "a", "status": "ok"}, None),
        ('{"name":"a"}', None, "invalid_or_missing_json"),
        ('{"name":"a","status":"other"}', None, "invalid_field_values"),
        ('x {"name":"a","status":"other"} {"name":"b","status":"bad"}', {"name": "b", "status": "bad"}, None),
        ('{"name":"a","status":"ok"} trailing', {"name": "a", "status": "ok"}, None),
        ("{'name':'a','status':'ok'}", None, "invalid_or_missing_json"),
        ('{"name":"a","name":"b","status":"ok"}', {"name": "b", "status": "ok"}, None),
        ('[{"name":"a","status":"ok"}]', {"name": "a", "status": "ok"}, None),
        ('say {"name":{"x":1},"status":"ok"}', None, "invalid_or_missing_json"),
        ("", None, "empty_ai_response"),
        (None, None, "empty_ai_response"),
        ("   ", None, "invalid_or_missing_json"),
    ],
)
def test_replies(text, data, error):
    got = reply.parse(text, ["name", "status"], RULES)
    assert (json.loads(got[0]) if got[0] else None, got[1]) == (data, error)


def test_values_agree_in_type():
    assert reply.value_errors({"n": 1}, {"n": [True, 1.0]}) and not reply.value_errors({"n": 1}, {"n": [1]}) and not reply.value_errors({"x": 1}, {"n": [1]})


def test_reply_columns(spark):
    df = spark.createDataFrame([('```json\n{"a":1,}\n``` {"b":[1,]}',), ("none",), (None,)], "r string")
    rows = df.select(reply.fenced(F.col("r")).alias("f"), reply.without_trailing_commas(F.col("r")).alias("t"), reply.object_candidates(F.col("r")).alias("c"), reply.parse_reply(F.col("r"), ["a"]).alias("p")).collect()
    assert rows[0].f == '{"a":1,}' and rows[0].t.endswith('{"b":[1]}') and len(rows[0].c) == 2 and rows[0].p.data_json == '{"a":1}'
    assert rows[1].f == "" and rows[1].p.error == "invalid_or_missing_json" and rows[2].p.error == "empty_ai_response"
    stream = 'data: {"choices":[{"delta":{"content":"Hel"}}]}\n\ndata: {"choices":[{"delta":{}}]}\n\ndata: {"choices":[{"delta":{"content":"lo"}}]}\n\ndata: [DONE]\n'
    assert spark.createDataFrame([(stream,)], "s string").select(reply.stream_text(F.col("s"))).first()[0] == "Hello"


def test_configuration():
    assert deep_merge({"a": {"b": 1, "c": [1]}, "d": 1}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}, "d": 1}
    with pytest.raises(ValueError):
        configured({"columns_to_extract": ["a"]})
    assert [token_mode(m) for m in ("input", "IO", "input_output", "out", "what", None)] == ["in", "io", "io", "out", "in", "in"]
    with pytest.raises(ValueError):
        identifier("a b")


def test_retry_decisions(spark):
    rows = [("api_error", 0, 9.0), ("api_error", 1, 1.0), ("api_error", 3, 9.0), ("content_error", 0, 9.0), ("content_error", 1, 9.0), ("system_error", 0, 9.0), ("system_error", 1, 9.0)]
    df = spark.createDataFrame(rows, "k string, n int, s double")
    got = [tuple(r[0]) for r in df.select(infer.decision(F.col("k"), F.col("n"), F.col("s"), {"api_error": 3, "content_error": 1}, 2)).collect()]
    assert got == [("pause", True), ("retry", True), ("fail", False), ("retry", False), ("fail", False), ("retry", True), ("fail", False)]


def test_decisions_of_rows_and_columns_agree(spark):
    retry = infer.Retry({"api_error": 3, "content_error": 1}, window=2.0)
    rows = [(k, n, s) for k in ("api_error", "content_error", "system_error") for n in range(5) for s in (0.0, 2.0, 9.0)]
    df = spark.createDataFrame(rows, "k string, n int, s double").coalesce(1)
    got = [tuple(r[0]) for r in df.select(infer.decision(F.col("k"), F.col("n"), F.col("s"), retry.limits, retry.window)).collect()]
    assert got == [infer.decide(k, n, s, retry) for k, n, s in rows]


def test_rows_are_read_again_before_a_retry(spark):
    """The source changes between tries: API and system errors see the new row, content errors the old one, and a row that is gone ends its tries."""
    asks = ["api:1", "system:1", "content:1", "api:9", "api:2"]
    df = spark.createDataFrame(list(enumerate(asks)), "id int, prompt string").coalesce(1)

    def make_reread():
        def reread(row):
            if row["id"] == 4:
                raise OSError("source is away")
            return None if row["id"] == 3 else {"prompt": "api:0"}

        return reread

    out = infer.infer(df, Flaky, ["id"], ["answer"], retry=infer.Retry(pause=0.0), concurrency=1, make_reread=make_reread)
    got = {r.id: (r.reply_json and json.loads(r.reply_json)["answer"], r._error_type, r.attempts) for r in out.collect()}
    assert {k: got[k] for k in (0, 1, 3, 4)} == {0: (1, None, 2), 1: (2, None, 2), 3: (None, "system_error", 1), 4: (None, "system_error", 1)}
    assert got[2] == (2, None, 2)


def test_tokens_are_counted_by_a_vocabulary(spark):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(1, "the first text", None), (2, "a \u00e9t\u00e9 second", "done"), (3, "third", None)], "id int, q string, a string")
    spec = TaskSpec(("q",), {"a": "a"})
    got = tokens.estimate(df, spec, "Q: {record_json}", "Sys", "io", count=tokens.by_ranks(path, public_tokenizers.PATTERN))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    said = df.select(tokens.input_tokens(df, spec, "Q: {record_json}", "Sys", lambda c: c).alias("t")).collect()
    want = [len(encoding.encode_ordinary(r.t)) for r in said]
    inputs, outputs = got["input_tokens"].first(), got["output_tokens"].first()
    assert (inputs.total_estimated, inputs.min, inputs.max) == (sum(want), min(want), max(want)) and outputs.sample_count == 1


def test_counting_by_a_vocabulary_takes_one_worker_and_small_batches(spark):
    import public_tokenizers

    count = tokens.by_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    df = spark.range(0, 3000, 1, 1).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("q"), F.lit("done").alias("a"))
    got = tokens.estimate(df, TaskSpec(("q",), {"a": "a"}, "id"), "Q: {record_json}", "", "io", count=count)
    for side in ("input_tokens", "output_tokens"):
        assert got[side]._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
        assert got[side].first().sample_count == 3000
    rows_of_batch = F.arrow_udf(lambda a: pa.array([len(a)] * len(a), pa.int64()), "bigint")
    assert df.select(F.max(rows_of_batch("q"))).first()[0] <= 1024


class Flaky:
    """Fails by what the prompt says, a number of times."""

    def __init__(self):
        self.seen = {}

    def call(self, messages, model, temperature):
        said = messages[-1]["content"]
        kind, times = said.split(":")
        self.seen[said] = self.seen.get(said, 0) + 1
        if self.seen[said] <= int(times):
            if kind == "api":
                raise infer.ApiError("busy")
            if kind == "content":
                return "no json"
            raise RuntimeError("broken")
        return json.dumps({"answer": self.seen[said]})


def test_retries_by_class(spark):
    asks = ["api:0", "api:3", "api:4", "content:1", "content:2", "system:2", "system:3", ""]
    df = spark.createDataFrame(list(enumerate(asks)), "id int, prompt string").coalesce(1)
    out = infer.infer(df, Flaky, ["id"], ["answer"], retry=infer.Retry(pause=0.0), concurrency=4)
    got = {r.id: (json.loads(r.reply_json)["answer"] if r.reply_json else None, r._error_type, r.attempts, len(r.errors)) for r in out.collect()}
    assert got == {0: (1, None, 1, 0), 1: (4, None, 4, 3), 2: (None, "api_error", 4, 4), 3: (2, None, 2, 1), 4: (None, "content_error", 2, 2), 5: (3, None, 3, 2), 6: (None, "system_error", 3, 3), 7: (None, "system_error", 0, 0)}


def test_breaker_pauses_once_within_its_window():
    now, slept = [0.0], []
    b = infer.Breaker(infer.Retry(pause=2.0, window=3.0), clock=lambda: now[0], sleep=slept.append)
    b.failed()
    b.failed()
    b.wait()
    now[0] = 2.5
    b.failed()  # within the window after the pause
    b.wait()
    now[0] = 6.0
    b.failed()
    b.wait()
    assert slept == [2.0, 2.0]


def test_calls_run_at_the_same_time(spark):
    df = spark.range(32).select("id", F.lit("x").alias("prompt")).coalesce(1)
    out = infer.infer(df, lambda: infer.FakeClient(lambda m: "{}", seconds=0.2), ["id"], concurrency=16)
    out.limit(1).collect()
    began = time.time()
    assert out.count() == 32 and time.time() - began < 3


CONFIG = {
    "columns_to_extract": ["question", "context"],
    "columns_to_write": {"answer": "ai_answer", "kind": "ai_kind"},
    "prompt": {"template": "Base {record_json}", "required_fields": ["answer"]},
    "validation": {"enabled": True, "field_rules": {"kind": ["a", "b"]}},
    "routing": {"enabled": True, "field": "lang", "subtasks": [{"match": "de", "profile": {"prompt": {"template": "Deutsch {record_json}", "system_prompt": "Sie"}}}]},
    "datasource": {"concurrency": {"retry_limits": {"content_error": 0}, "api_pause_duration": 0.0}},
}


def answer(messages):
    said = messages[-1]["content"]
    if '"question":"bad"' in said:
        return '{"answer":"x","kind":"z"}'
    return json.dumps({"answer": f"{len(messages)} {said}", "kind": "a"})


@pytest.fixture
def table(spark):
    rows = [(1, "q1", "c1", "de", None, None), (2, "q2", "c2", "fr", "done", "a"), (3, "", "c3", "de", None, None), (4, "bad", "c4", None, None, None), (5, "q5", "c5", "en", "half", " ")]
    return spark.createDataFrame(rows, "id int, question string, context string, lang string, ai_answer string, ai_kind string")


def test_enrichment(spark, table, tmp_path):
    plan = Enrichment(spark, CONFIG, lambda: infer.FakeClient(answer), str(tmp_path))
    done, figures = plan.run(table)
    got = {r.id: (r.ai_answer, r.ai_kind) for r in done.collect()}
    assert got == {
        1: ('2 Deutsch {"question":"q1","context":"c1"}', "a"),
        2: ("done", "a"),
        3: (None, None),
        4: ("ERROR: content_error - invalid_field_values",) * 2,
        5: ('1 Base {"question":"q5","context":"c5"}', "a"),
    }
    assert figures.first().asDict() == {"n_tasks": 3, "n_ok": 2, "n_failed": 1, "n_retries": 0, "success_rate": pytest.approx(2 / 3), "n_api_error": 0, "n_content_error": 1, "n_system_error": 0}
    assert plan.pending(done).count() == 0 and done.columns == table.columns
    left, _ = plan.run(table, on_failure="leave")
    assert {r.id for r in plan.pending(left).collect()} == {4}


def test_missing_output_columns_are_made(spark, table, tmp_path):
    plan = Enrichment(spark, CONFIG, lambda: infer.FakeClient(answer), str(tmp_path))
    done, _ = plan.run(table.drop("ai_kind"))
    assert done.where("id = 1").first().ai_kind == "a" and with_outputs(table.drop("ai_kind"), plan.spec).columns[-1] == "ai_kind"
    assert tuple(plan.progress(table).first()) == (5, 3, 1)


def test_token_estimates(spark):
    df = spark.createDataFrame([(1, "aa", None), (2, "bbb", "out"), (3, "", None)], "id int, q string, a string")
    spec = TaskSpec(("q",), {"x": "a"})
    full = tokens.estimate(df, spec, "{record_json}", mode="io")
    assert full["input_tokens"].first().sample_count == 3 and full["output_tokens"].first().max == len('{"x":"out"}')
    some = tokens.estimate(df, spec, "{record_json}", "SYS", "in", sample=10)["input_tokens"].first()
    assert (some.sample_count, some.total_estimated) == (1, len('SYS\n{"q":"aa"}'))
    assert tokens.estimate(df.limit(0), spec, "{record_json}")["input_tokens"].first().sample_count == 0
