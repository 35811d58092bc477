import json
import subprocess
import sys
from collections import Counter
from pathlib import Path

from tablemill.operators import infer
from tablemill.operators.journal import Journal, key_of, logged
from tablemill.operators.rounds import infer_rounds
from tablemill.plans.enrich import Enrichment
from tablemill.sources import files
from tablemill.streaming import incremental


def dying(tmp_path, mode):
    run = subprocess.run([sys.executable, str(Path(__file__).with_name("dying_task.py")), str(tmp_path), mode], capture_output=True, text=True, timeout=300)
    return run.stdout.strip().splitlines(), run.stderr


def test_a_task_that_dies_sends_no_row_twice(tmp_path):
    said, err = dying(tmp_path, "once")
    assert said and (tmp_path / "died").exists(), err[-2000:]
    assert json.loads(said[-1]) == {str(k): 1 for k in range(60)}


def test_a_run_that_failed_goes_on_from_its_log(tmp_path):
    said, err = dying(tmp_path, "always")
    assert said[0].startswith("failed"), err[-2000:]
    said, err = dying(tmp_path, "never")
    assert json.loads(said[-1]) == {str(k): 1 for k in range(60)}, err[-2000:]


def test_log_segments(spark, tmp_path):
    log = Journal(f"file://{tmp_path}/log", 3, rows=2)
    row = {"prompt": "p", "model": None}
    outs = {key_of([k], row): (json.dumps({"a": k}), None, None, 1, ["api_error: x"]) for k in range(5)}
    for key, out in outs.items():
        log.add(key, out)
    assert {k: v for k, v in Journal(f"{tmp_path}/log", 3).known.items()} == {k: (*v[:4], list(v[4])) for k, v in list(outs.items())[:4]}
    log.flush()
    assert len(Journal(f"{tmp_path}/log", 3).known) == 5 and not Journal(f"{tmp_path}/log", 4).known
    rows = logged(spark, f"{tmp_path}/log").collect()
    assert {(r.key, r.reply_json, r.attempts, tuple(r.errors)) for r in rows} == {(k, v[0], 1, ("api_error: x",)) for k, v in outs.items()}
    assert key_of([1], row) != key_of([1], {"prompt": "q", "model": None})


class Client:
    """Fails as its rows say: ``api``, ``system`` or ``content``, else answers with the text."""

    def call(self, messages, model, temperature):
        text = json.loads(messages[-1]["content"])["q"]
        if text.startswith("api"):
            raise infer.ApiError("down")
        if text.startswith("system"):
            raise ValueError("odd")
        return "no idea" if text.startswith("content") else json.dumps({"a": text.upper()})


CONFIG = {"datasource": {"type": "parquet", "concurrency": {"retry_limits": {"api_error": 2, "content_error": 1, "system_error": 1}, "api_pause_duration": 2.0, "api_error_trigger_window": 0.0}}, "columns_to_extract": ["q"], "columns_to_write": {"a": "a"}, "prompt": {"template": "{record_json}", "required_fields": ["a"]}}
SCHEMA = "id bigint, q string, a string"


def test_rounds_read_what_failed_again_and_pause_together(spark, tmp_path):
    source = f"{tmp_path}/tasks.parquet"
    now = {1: "fine", 2: "api", 3: "api", 4: "system", 5: "content", 6: "gone api", 7: "api x"}
    now[6] = "api gone"
    write = lambda: files.write(spark.createDataFrame([(i, q, None) for i, q in now.items()], SCHEMA), source)
    write()
    pauses = []

    def sleep(seconds):
        pauses.append(seconds)
        if len(pauses) == 1:  # while all wait, the source changes
            now.update({2: "better", 4: "well", 5: "changed but sent as it was"})
            del now[6]
            write()

    config = {**CONFIG, "datasource": {**CONFIG["datasource"], "input_path": source}}
    plan = Enrichment(spark, config, Client, f"{tmp_path}/work")
    done, figures = plan.run_source("one", sleep=sleep)
    got = {r.id: r.a for r in done.collect()}
    assert (got[1], got[2], got[4]) == ("FINE", "BETTER", "WELL") and set(got) == {1, 2, 3, 4, 5, 7}
    assert got[3].startswith("ERROR: api_error") and got[5].startswith("ERROR: content_error") and got[7].startswith("ERROR: api_error")
    assert pauses == [2.0, 2.0]
    said = {r.id: r for r in plan.replies_in_rounds(lambda: spark.read.parquet(source), "one", sleep=sleep).collect()}
    assert {i: r.attempts for i, r in said.items()} == {1: 1, 2: 2, 3: 3, 4: 2, 5: 2, 6: 1, 7: 3} and len(pauses) == 2
    assert said[6]._error.startswith("reload_failed") and said[6]._error_type == "system_error"
    assert said[3].errors == ["api_error: down"] * 3 and said[1].errors == []
    f = figures.first()
    assert (f.n_tasks, f.n_ok, f.n_api_error, f.n_content_error, f.n_system_error) == (7, 3, 2, 1, 1)


def test_rounds_over_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id bigint, prompt string")
    out = infer_rounds(lambda: none, lambda ids: none, Client, "id", f"{tmp_path}/none")
    assert out.count() == 0 and out.columns == ["id", "reply_json", "_error", "_error_type", "attempts", "errors"]


def test_no_pause_within_the_window_and_none_without_api_errors(spark, tmp_path):
    rows = spark.createDataFrame([(1, json.dumps({"q": "content"})), (2, json.dumps({"q": "system"}))], "id bigint, prompt string")
    again = lambda ids: rows.join(ids, "id", "left_semi")
    pauses = []
    infer_rounds(lambda: rows, again, Client, "id", f"{tmp_path}/a", ["a"], sleep=pauses.append).collect()
    assert pauses == []
    api = spark.createDataFrame([(1, json.dumps({"q": "api"}))], "id bigint, prompt string")
    out = infer_rounds(lambda: api, lambda ids: api, Client, "id", f"{tmp_path}/b", ["a"], retry=infer.Retry(pause=3.0, window=1000.0), sleep=pauses.append).collect()
    assert pauses == [3.0] and out[0].attempts == 4


class Counting:
    def __init__(self, path):
        self.path = path

    def call(self, messages, model, temperature):
        text = json.loads(messages[-1]["content"])["q"]
        with open(self.path, "a") as f:
            f.write(text + "\n")
        return json.dumps({"a": text.upper()})


def test_a_batch_that_runs_again_sends_nothing_twice(spark, tmp_path):
    calls = f"{tmp_path}/calls"
    plan = Enrichment(spark, {k: v for k, v in CONFIG.items() if k != "datasource"}, lambda: Counting(calls), f"{tmp_path}/work")
    source, results, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "cp"))

    def drain():
        q = incremental.enrich_stream(spark.readStream.schema(SCHEMA).parquet(source), plan, results, checkpoint)
        q.awaitTermination(120)
        assert q.exception() is None

    spark.createDataFrame([(1, "x", None), (2, "y", "done")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    drain()
    spark.createDataFrame([(3, "z", None)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    drain()
    # as if the stream had died after its work and before it noted that the batch is done
    for name in ("1", ".1.crc"):
        Path(f"{checkpoint}/commits/{name}").unlink(missing_ok=True)
    for f in Path(results, "batch=1").iterdir():
        f.unlink()
    drain()
    assert sorted((r.id, r.a) for r in spark.read.parquet(results).collect()) == [(1, "X"), (3, "Z")]
    assert Counter(Path(calls).read_text().split()) == {"x": 1, "z": 1}
