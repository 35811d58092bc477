import json

from tablemill.operators import infer
from tablemill.plans.enrich import Enrichment
from tablemill.streaming import incremental, stateful


def drained(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_growing_table(spark, tmp_path):
    config = {"columns_to_extract": ["q"], "columns_to_write": {"a": "a"}, "prompt": {"template": "{record_json}", "required_fields": ["a"]}}
    plan = Enrichment(spark, config, lambda: infer.FakeClient(lambda m: json.dumps({"a": json.loads(m[-1]["content"])["q"].upper()})), str(tmp_path / "work"))
    schema = "id int, q string, a string"
    source, results = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, "x", None), (2, "y", "done")], [(3, "z", None), (4, " ", None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        drained(incremental.enrich_stream(stream, plan, results, str(tmp_path / "cp")))
    assert sorted((r.id, r.a) for r in spark.read.parquet(results).collect()) == [(1, "X"), (3, "Z")]
    seen = []
    drained(incremental.merge_stream(spark.readStream.schema("id int, a string, _error string, _error_type string").parquet(results), lambda df, n: seen.extend(r.id for r in df.collect()), str(tmp_path / "cp2")))
    assert sorted(seen) == [1, 3]


def replay(spark, tmp_path, name, schema, batches, make, mode):
    source = str(tmp_path / name)
    out = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(schema).parquet(source))
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-cp")).foreachBatch(lambda df, n: out.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
        drained(q)
    return out


def test_bucket_over_batches(spark, tmp_path):
    batches = [[("a", 1.5), ("a", 1.5), ("b", 1.0)] + [("a", 1.0)] * 3, [("a", 9.0)], [("z", 100.0)]]
    got = replay(spark, tmp_path, "bucket", "k string, t double", batches, lambda s: stateful.admitted(s, "k", "t", rps=1.0, delay="0 seconds"), "append")
    assert sorted(got)[:4] == [("a", 1.0, 3, 2), ("a", 1.5, 2, 0), ("a", 9.0, 1, 1), ("b", 1.0, 1, 1)]


def test_backoff_over_batches(spark, tmp_path):
    # rows of a batch in any order, and one that comes late but within the delay
    batches = [[("m", 2.0, False), ("m", 1.0, False)], [("m", 12.0, False)], [("m", 11.0, False)], [("m", 30.0, True), ("m", 30.0, False)], [("z", 100.0, True)]]
    got = replay(spark, tmp_path, "backoff", "k string, t double, ok boolean", batches, lambda s: stateful.backoffs(s, "k", "t", "ok", delay="5 seconds"), "append")
    assert [g for g in got if g[0] == "m"] == [("m", 1.0, 1, 3.0), ("m", 2.0, 2, 6.0), ("m", 11.0, 3, 17.0), ("m", 12.0, 4, 20.0), ("m", 30.0, 0, 0.0)]


def test_retry_records_expire(spark, tmp_path):
    batches = [[("x", "api_error", 1.0), ("y", "system_error", 1.0)], [("x", "content_error", 2.0), ("x", "api_error", 3.0)], [("z", "api_error", 200.0)], [("x", "api_error", 201.0)]]
    got = replay(spark, tmp_path, "retry", "k string, kind string, t double", batches, lambda s: stateful.retry_records(s, "k", "kind", "t", expiry_ms=100_000, delay="0 seconds"), "update")
    assert [g for g in got if g[0] == "x"] == [("x", 1, 0, 0, 1.0), ("x", 2, 1, 0, 3.0), ("x", 1, 0, 0, 201.0)]


class Store:
    """State of one key, as a processor sees it."""

    def __init__(self):
        self.map, self.value, self.timers = {}, None, set()

    def getMapState(self, name, key_schema, value_schema):
        m = self.map
        return type("Map", (), {"containsKey": lambda _, k: k in m, "getValue": lambda _, k: m[k], "updateValue": lambda _, k, v: m.__setitem__(k, v), "removeKey": lambda _, k: m.pop(k)})()

    def getValueState(self, name, schema):
        return type("Value", (), {"exists": lambda _: self.value is not None, "get": lambda _: self.value, "update": lambda _, v: setattr(self, "value", v)})()

    def registerTimer(self, ms):
        self.timers.add(ms)


def test_a_keys_batch_is_read_piece_by_piece():
    """Each piece of a key's rows is let go before the next is asked for, and what stays is a row for each time."""
    import gc
    import random
    import weakref

    import pandas as pd

    rng, alive, rows = random.Random(3), [], []

    def pieces():
        for _ in range(200):
            part = [(rng.randrange(50) * 1000, rng.random() < 0.2) for _ in range(500)]
            rows.extend(part)
            frame = pd.DataFrame(part, columns=["ms", "good"])
            alive.append(weakref.ref(frame))
            yield frame
            del frame
            gc.collect()
            assert sum(r() is not None for r in alive) <= 1

    store, processor = Store(), stateful.Backoffs(2.0)
    processor.init(store)
    list(processor.handleInputRows(("m",), pieces(), None))
    assert len(store.map) == 50 and store.timers == {ms for ms, _ in rows}
    for ms in sorted(store.timers):
        list(processor.handleExpiredTimer(("m",), None, type("Expired", (), {"getExpiryTimeInMs": lambda _, t=ms: t})()))
    fails = 0
    for ms in sorted({ms for ms, _ in rows}):
        outcomes = [good for t, good in rows if t == ms]
        fails = 0 if any(outcomes) else fails + len(outcomes)
    assert store.value[0] == fails and not store.map
