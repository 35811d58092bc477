import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablemill.operators import dispatch, merge, routing, sharding, stats, validation
from tablemill.plans.spec import TaskSpec


def values(df):
    return sorted(tuple(r) for r in df.collect())


# ---- shards


def test_shard_size_is_clamped():
    assert sharding.shard_size() == 10_000
    assert sharding.shard_size(optimal=50, least=100) == 100
    assert sharding.shard_size(free_mb=50) == 3072
    assert sharding.shard_size(records_per_second=4) == 3600
    assert sharding.shard_size(optimal=10**6) == 50_000


@pytest.mark.parametrize(("low", "high", "size"), [(0, 99, 50), (0, 100, 50), (5, 5, 10), (-3, 8, 4), (0, -1, 5)])
def test_ranges_cover_the_ids_once(spark, low, high, size):
    rows = values(sharding.ranges(spark, low, high, size))
    assert [i for _, a, b in rows for i in range(a, b + 1)] == list(range(low, high + 1))
    if high >= low:
        df = spark.createDataFrame([(low,), (high,)], "id bigint")
        assert values(sharding.shard_ranges(df, "id", size)) == rows
        assert values(df.select(sharding.shard_of(F.col("id"), low, size)))[-1][0] == rows[-1][0]


def test_shards_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id bigint")
    assert sharding.shard_ranges(df, "id", 10).count() == 0 and tuple(sharding.bounds(df, "id").first()) == (None, None, 0)
    with pytest.raises(ValueError):
        sharding.shard_ranges(df, "id", 0)


# ---- merges


def test_cells_change_and_frames_do_not(spark):
    df = spark.createDataFrame([(0, "a", None), (1, "b", "done")], "id int, input string, output string")
    assert values(merge.set_cell(df, "id", 0, "output", "new")) == [(0, "a", "new"), (1, "b", "done")]
    updates = spark.createDataFrame([(0, "output", "x", 1), (0, "output", "y", 2), (1, "input", "z", 1), (9, "output", "q", 1), (1, "gone", "q", 1), (1, "output", None, 3)], "id int, column string, value string, seq int")
    assert values(merge.set_cells(df, updates, "id").fillna("-")) == [(0, "a", "y"), (1, "z", "-")]
    assert df.where("id = 0").first().output is None


def test_write_back_modes(spark):
    base = spark.createDataFrame([(1, "in", None, "old"), (2, "in", None, "old"), (3, "in", None, "old")], "id int, q string, a string, b string")
    spec = TaskSpec(("q",), {"x": "a", "y": "b"})
    results = spark.createDataFrame([(1, "new", None, None), (2, None, "limit", "api_error"), (9, "lost", None, None)], "id int, x string, _error string, _error_type string")
    out = lambda **o: [(r.a, r.b) for r in merge.write_back(base, results, spec, **o).orderBy("id").collect()]
    assert out() == [("new", "old"), (None, "old"), (None, "old")]
    assert out(missing="null") == [("new", None), (None, "old"), (None, "old")]
    assert out(missing="blank") == [("new", ""), (None, "old"), (None, "old")]
    assert out(on_failure="mark")[1] == ("ERROR: api_error - limit", "ERROR: api_error - limit")
    assert values(merge.unmatched(base, results, "id").select("id")) == [(9,)]
    again = merge.write_back(merge.write_back(base, results, spec), results, spec)
    assert values(again.fillna("-")) == values(merge.write_back(base, results, spec).fillna("-"))
    with pytest.raises(ValueError):
        merge.write_back(base, results, spec, missing="other")


def test_write_back_keeps_the_last_result_and_types(spark):
    base = spark.createDataFrame([(1, "in", 0)], "id int, q string, n int")
    results = spark.createDataFrame([(1, "5", 1), (1, "7", 2), (1, "6", 0)], "id int, n string, seq int")
    assert merge.write_back(base, results, TaskSpec(("q",), {"n": "n", "m": "m"}), order="seq").first().asDict() == {"id": 1, "q": "in", "n": 7, "m": None}


@given(st.lists(st.integers(0, 60), max_size=40))
@settings(max_examples=12, deadline=None)
def test_runs_of_rows(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "r int")
    got = values(merge.consecutive(df, "r", block=7))
    assert [i for a, b, _ in got for i in range(a, b + 1)] == sorted(set(rows))
    assert all(b + 1 < a2 for (_, b, _), (a2, _, _) in zip(got, got[1:], strict=False))


# ---- routing and validation


def test_routes(spark):
    config = {"prompt": {"template": "base", "temperature": 0.5, "required_fields": ["a"]}}
    known = routing.profiles(spark, config, [{"match": "x", "profile": {"prompt": {"template": "first"}}}, {"match": "x", "profile": {"prompt": {"template": "last"}}}, {"match": 7, "profile": {}}])
    df = spark.createDataFrame([("x",), ("7",), ("",), (None,), ("None",)], "r string")
    assert [tuple(r) for r in routing.route(df, "r", known, ["template", "temperature"]).collect()] == [("x", "last", 0.5, True), ("7", "base", 0.5, True), ("", "base", 0.5, False), (None, "base", 0.5, False), ("None", "base", 0.5, False)]
    with pytest.raises(ValueError):
        routing.profiles(spark, config, [{"match": "y", "profile": {"models": {}}}])
    with pytest.raises(ValueError):
        routing.profiles(spark, config, [{"profile": {}}])


def test_enum_rules_on_columns(spark):
    df = spark.createDataFrame([("A", "x", 1, True), ("a", None, 2, False)], "category string, other string, n int, flag boolean")
    errors = validation.enum_errors(df, {"category": ["A", "B"], "gone": ["x"], "n": [1, "1", True], "flag": [1, True]})
    assert [r[0] for r in df.select(errors).collect()] == [[], ["category", "n", "flag"]]
    assert df.select(validation.enum_errors(df, {})).first()[0] == []
    assert validation.rule_sizes({"a": [1, 2]}) == {"a": 2}


def test_required_fields_and_schema(spark):
    df = spark.createDataFrame([('{"a":1,"b":null}',), ("[1]",), (None,)], "j string")
    assert [sorted(r[0]) for r in df.select(validation.missing_fields(F.col("j"), ["a", "b", "c"])).collect()] == [["c"], ["a", "b", "c"], ["a", "b", "c"]]
    schema = validation.json_schema(["c", "n", "f", "t"], {"c": ["A"], "n": [1], "f": [True], "x": [2.5]})
    assert schema["properties"] == {"c": {"type": "string", "enum": ["A"]}, "n": {"type": "integer", "enum": [1]}, "f": {"type": "boolean", "enum": [True]}, "t": {"type": "string"}}
    assert validation.json_schema([]) is None


# ---- statistics


def test_token_stats_by_nearest_rank(spark):
    df = spark.createDataFrame([(v,) for v in (10, 20, 30, 40, 50)], "n int")
    assert stats.token_stats(df, "n", 100).first().asDict() == {"total_estimated": 3000, "avg": 30.0, "min": 10, "max": 50, "p50": 30, "p90": 50, "p99": 50, "sample_count": 5}
    assert stats.token_stats(spark.range(1, 11), "id").first().p50 == 6
    assert stats.token_stats(df.limit(0), "n").first().asDict() == {"total_estimated": 0, "avg": 0.0, "min": 0, "max": 0, "p50": 0, "p90": 0, "p99": 0, "sample_count": 0}


@given(st.lists(st.integers(0, 20), min_size=1, max_size=60))
@settings(max_examples=10, deadline=None)
def test_percentiles_against_sorting(spark, v):
    row = stats.token_stats(spark.createDataFrame([(x,) for x in v], "n int"), "n").first()
    s = sorted(v)
    assert [row.p50, row.p90, row.p99] == [s[min(int(len(s) * p / 100), len(s) - 1)] for p in (50, 90, 99)]


def test_ema_and_progress(spark):
    df = spark.createDataFrame([("a", 1, 0.2), ("a", 2, 0.1), ("b", 1, 3.0), ("b", 2, None)], "k string, t int, v double")
    assert {r.k: (pytest.approx(r.ema), r.n) for r in stats.ema(df, "k", "v", ["t"]).collect()} == {"a": (0.19, 2), "b": (3.0, 1)}
    df = spark.createDataFrame([(0, 100), (50, 100), (100, 100), (0, 0)], "d int, t int")
    assert [r[0] for r in df.select(stats.progress_percent(F.col("d"), F.col("t"))).collect()] == [0, 50, 100, 100]


def test_last_errors(spark):
    df = spark.createDataFrame([("a", i, f"m{i}") for i in range(8)], "k string, t int, m string")
    assert sorted(r.m for r in stats.last_errors(df, "k", ["t"], ["m"]).collect()) == ["m3", "m4", "m5", "m6", "m7"]


# ---- dispatch


def test_backoff_and_rates(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 5, 8, 9, 20)], "n int")
    assert [r[0] for r in df.select(dispatch.backoff_seconds(F.col("n"))).collect()] == [0, 2, 4, 6, 8, 10, 38, 60, 60]
    df = spark.createDataFrame([(1.0,), (50.0,), (1000.0,)], "w double")
    assert [r[0] for r in df.select(dispatch.default_rps(F.col("w"))).collect()] == [0.5, 5.0, 10.0]
    df = spark.createDataFrame([(5.0, 4.0), (4.0, 5.0), (4.0, None)], "now double, next double")
    assert [r[0] for r in df.select(dispatch.available(F.col("next"), F.col("now"))).collect()] == [True, False, True]


def test_weighted_choice(spark):
    df = spark.range(20_000)
    got = df.groupBy(dispatch.weighted_pick(dispatch.hash_unit(F.col("id")), [("a", 1), ("b", 3), ("c", 0)]).alias("p")).count()
    n = {r.p: r["count"] for r in got.collect()}
    assert set(n) == {"a", "b"} and abs(n["b"] / 20_000 - 0.75) < 0.02
    assert df.limit(1).select(dispatch.weighted_pick(F.lit(0.5), [])).first()[0] is None


MODELS = [{"id": "1", "name": "small", "model": "s", "weight": 5, "channel_id": "c", "timeout": 90}, {"id": "2", "name": "big", "model": "s", "weight": 5, "channel_id": "c"}, {"id": "3", "name": "1", "weight": 0}]


def test_names_and_picks(spark):
    known = dispatch.models(spark, MODELS)
    assert {r.asked: r.id for r in dispatch.name_map(known).collect()} == {"1": "3", "small": "1", "s": "2", "2": "2", "big": "2", "3": "3"}
    assert values(dispatch.exposed_models(known)) == [("big", "2"), ("small", "1")]
    asks = spark.createDataFrame([(1, "big", None), (2, "auto", ["1"]), (3, "1", ["1"]), (4, "auto", ["1", "2"])], "k int, asked string, tried array<string>")
    out = dispatch.pick_model(dispatch.resolve(asks, "asked", known), "k", known, "wanted", "tried")
    assert {r.k: r.picked for r in out.collect()} == {1: "2", 2: "2", 3: "2", 4: None}
    down = known.withColumn("usable", F.col("id") != "2")
    assert {r.k: r.picked for r in dispatch.pick_model(dispatch.resolve(asks.where("k = 1"), "asked", down), "k", down, "wanted").collect()} == {1: "1"}


def test_channels(spark):
    known = dispatch.models(spark, MODELS[:2])
    channels = spark.createDataFrame([("c", "http://x", 60.0)], "id string, base_url string, timeout double")
    assert [(r.id, r.timeout) for r in dispatch.with_channels(known, channels).orderBy("id").collect()] == [("1", 60.0), ("2", 60.0)]
    with pytest.raises(Exception, match="no channel"):
        dispatch.with_channels(dispatch.models(spark, MODELS[2:]), channels).collect()


def test_token_bucket_replay(spark):
    df = spark.createDataFrame([("a", t, k) for k, t in enumerate([0.0] * 12 + [0.2, 0.3, 5.0])] + [("b", 0.0, 1)], "k string, t double, n int")
    got = {(r.k, r.n): r.admitted for r in dispatch.token_bucket(df, "k", "t", "n", rps=5).collect()}
    assert [got["a", n] for n in range(15)] == [True] * 10 + [False] * 2 + [True, False, True] and got["b", 1]


def test_health_and_rates(spark):
    states = spark.createDataFrame([(True,), (False,)], "usable boolean")
    assert tuple(dispatch.health(states).first()) == ("degraded", 1, 2)
    assert dispatch.health(states.where("usable")).first().status == "healthy" and dispatch.health(states.where("not usable")).first().status == "unhealthy"
    assert dispatch.health(states.limit(0)).first().status == "unhealthy"
    log = spark.createDataFrame([("m", 1, True, 0.5), ("m", 2, False, 1.5), ("m", 3, False, 1.0), ("n", 1, False, 1.0)], "model string, ts int, ok boolean, seconds double")
    assert {r.model: (r.n_ok, r.n_failed, r.avg_seconds, r.last_fails) for r in dispatch.model_stats(log).collect()} == {"m": (1, 2, 1.0, 2), "n": (0, 1, 1.0, 1)}


def test_addresses(spark):
    channels = spark.createDataFrame([("https://API.example.com/v1", ["1.2.3.4", "bad", "1.2.3.5"], None, 0), ("https://api.example.com", ["1.2.3.5", "::1", "01.2.3.4"], "", 1), ("https://other.com", ["9.9.9.9"], "http://proxy", 2), (None, ["8.8.8.8"], None, 3)], "base_url string, ip_pool array<string>, proxy string, position int")
    assert [tuple(r) for r in dispatch.ip_pools(channels).collect()] == [("api.example.com", ["1.2.3.4", "1.2.3.5", "::1"])]
    df = spark.createDataFrame([(["a", "b", "c"], 4), (["a"], 3), ([], 2)], "l array<string>, n int")
    assert [r[0] for r in df.select(dispatch.rotate(F.col("l"), F.col("n"))).collect()] == [["b", "c", "a"], ["a"], []]


def test_request_params(spark):
    df = spark.createDataFrame([(None, True), (0.1, False)], "t double, s boolean")
    made = dispatch.request_params(F.col("t"), F.lit(0.7), {"top_p": F.lit(0.9)}, F.col("s"))
    assert [tuple(r) for r in df.select(*[c.alias(n) for n, c in made.items()]).collect()] == [(0.7, 0.9), (0.1, None)]


def test_runs_over_many_block_borders(spark):
    import random

    rng = random.Random(3)
    rows = sorted({(rng.choice("ab"), v) for v in range(-60, 400) for _ in range(2) if rng.random() < 0.8} | {("c", v) for v in range(64)})
    want = []
    for k, v in rows:
        if want and want[-1][0] == k and want[-1][2] + 1 == v:
            want[-1][2] = v
        else:
            want.append([k, v, v])
    for df, by, expected in ((spark.createDataFrame(rows, "k string, v int"), ["k"], want), (spark.createDataFrame([r for r in rows if r[0] == "a"], "k string, v int"), None, [w for w in want if w[0] == "a"])):
        got = sorted((*([r.k] if by else ["a"]), r.lo, r.hi, r.n) for r in merge.consecutive(df, "v", by, block=16).collect())
        assert got == [(k, a, b, b - a + 1) for k, a, b in expected]


def test_several_results_for_an_id_have_one_outcome(spark):
    spec = TaskSpec(("q",), {"x": "a", "y": "b"})
    df = spark.createDataFrame([(1, "q", None, None)], "id int, q string, a string, b string")
    updates = [(1, f"v{k}", f"w{9 - k}") for k in range(10)]
    for seed in range(3):
        results = spark.createDataFrame(updates[seed:] + updates[:seed], "id int, x string, y string").repartition(4)
        assert tuple(merge.write_back(df, results, spec).first()) == (1, "q", "v9", "w0")


def test_shards_of_sparse_ids(spark):
    ids = spark.createDataFrame([(5,), (10**15,)], "id bigint")
    shards = sharding.shard_ranges(ids, "id", 10**9)
    assert shards.count() == 10**6 and shards.first().lo == 5 and shards.agg({"hi": "max"}).first()[0] == 10**15
    assert sharding.shard_ranges(ids.limit(0), "id", 10).count() == 0


def test_folds_of_a_hot_key_over_ranges(spark):
    """A key with nearly all rows, others and null ones, against plain loops; the rows are dealt by their order."""
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), t, None if rng.random() < 0.05 else rng.random(), rng.choice([True, False, False, None])) for t in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t int, v double, ok boolean").repartition(5)
    for alpha in (0.001, 0.3):
        want = {}
        for k, _, v, _ in sorted(rows, key=lambda r: r[1]):
            if v is not None:
                e, n = want.get(k, (v, 0))
                want[k] = (e + alpha * (v - e), n + 1)
        out = stats.ema(df, "k", "v", ["t"], alpha)
        assert {r.k: (pytest.approx(r.ema, rel=1e-9), r.n) for r in out.collect()} == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning(_o0" in plan and "Join" not in plan and "Window" not in plan
    want = {}
    for k, _, v, ok in sorted(rows, key=lambda r: r[1]):
        w = want.setdefault(k, [0, 0, [], 0])
        w[0], w[1], w[3] = w[0] + (ok is True), w[1] + (ok is False), 0 if ok else w[3] + (ok is False)
        w[2] += [v] if v is not None else []
    out = dispatch.model_stats(df.withColumnsRenamed({"k": "model", "t": "ts", "v": "seconds"}))
    got = {r.model: [r.n_ok, r.n_failed, r.avg_seconds, r.last_fails] for r in out.collect()}
    assert got == {k: [w[0], w[1], pytest.approx(sum(w[2]) / len(w[2])), w[3]] for k, w in want.items()}
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    numbered = spark.createDataFrame([(1, 1, 2.0), (None, 2, 3.0), (1, 3, 4.0)], "k bigint, t int, v double")
    assert {r.k: r.ema for r in stats.ema(numbered, "k", "v", ["t"], 0.5).collect()} == {1: 3.0, None: 3.0}
    assert stats.ema(numbered.limit(0), "k", "v", ["t"]).count() == 0


def test_nested_objects_in_replies():
    from tablemill.functions.reply import balanced_objects, parse

    said = 'Well { see {"a":{"b":1}} and {"a": "}{", "c": {"d": [{}]}} or "{" {x'
    assert list(balanced_objects(said)) == ['{"a":{"b":1}}', '{"a": "}{", "c": {"d": [{}]}}']
    assert list(balanced_objects('{"a": "\\\\", "b": "\\"}"} {')) == ['{"a": "\\\\", "b": "\\"}"}']
    assert parse(said, ["a"])[1] == "invalid_or_missing_json"
    assert parse(said, ["a"], nested=True)[0] == '{"a":{"b":1}}' and parse(said, ["c"], nested=True)[0] == '{"a":"}{","c":{"d":[{}]}}'
    assert parse("{" * 200_000 + "}" * 100_000, nested=True)[1] == "invalid_or_missing_json" and list(balanced_objects("")) == []
