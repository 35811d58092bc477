"""Queries over the test tables, one for each operator, with the SQL that says the same."""

from __future__ import annotations

import json
import os
import sqlite3
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablemill.functions import prompt, reply
from tablemill.functions.emptiness import BLANK, is_empty, known_text, to_text
from tablemill.operators import columns, dispatch, infer, merge, predicates, routing, sharding, stats, validation
from tablemill.plans import tokens
from tablemill.plans.enrich import Enrichment
from tablemill.plans.spec import TaskSpec, configured, spec_of
from tablemill.sources import files, open_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SPEC = TaskSpec(inputs=("text",), outputs={"quality": "quality", "toxic": "toxic"}, id_col="doc_id")
#: How SQL says the blank test; the expression is the same.
SQL_BLANK = BLANK.replace("'", "''")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels: a task table whose outputs are partly blank."""
    return _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")


def _seconds(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / 1000000


TASKS = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
VALID = f"NOT (text IS NULL OR regexp_matches(text, '{SQL_BLANK}'))"
PENDING = f"({VALID} AND (quality IS NULL OR toxic IS NULL))"

# ---- filters ----------------------------------------------------------------------------------------------------


@query(f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE {PENDING}) AS n_unprocessed, count(*) FILTER (WHERE quality IS NOT NULL AND toxic IS NOT NULL) AS n_processed FROM {TASKS}")
def task_counts(spark, d):
    return stats.counts(_tasks(spark, d), SPEC)


@query(f"SELECT doc_id FROM {TASKS} WHERE {PENDING}")
def unprocessed_rows(spark, d):
    df = _tasks(spark, d)
    return df.filter(predicates.unprocessed(df, SPEC)).select("doc_id")


@query(f"SELECT doc_id, CASE WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 'processed' WHEN {PENDING} THEN 'unprocessed' ELSE 'invalid' END AS status FROM {TASKS}")
def task_status(spark, d):
    df = _tasks(spark, d)
    return df.select("doc_id", predicates.status(df, SPEC).alias("status"))


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN ' ' WHEN turn % 3 = 1 THEN text END AS a, CASE WHEN turn % 2 = 0 THEN text ELSE '' END AS b, CASE WHEN role = 'user' THEN text END AS out FROM conversations)
SELECT conv_id, turn FROM t WHERE (trim(coalesce(a, '')) <> '' OR trim(coalesce(b, '')) <> '') AND (out IS NULL OR trim(out) = '')""")
def unprocessed_require_any(spark, d):
    c = _t(spark, d, "conversations")
    a = F.when(F.col("turn") % 3 == 0, " ").when(F.col("turn") % 3 == 1, F.col("text"))
    t = c.select("conv_id", "turn", a.alias("a"), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("").alias("b"), F.when(F.col("role") == "user", F.col("text")).alias("out"))
    spec = TaskSpec(("a", "b", "not_there"), {"out": "out"}, "conv_id", require_all=False)
    return t.filter(predicates.unprocessed(t, spec)).select("conv_id", "turn")


@query(f"""SELECT conv_id, turn, v IS NULL OR regexp_matches(v, '{SQL_BLANK}') AS blank, v IS NULL OR v = '' AS sql_empty
FROM (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN chr(12288) || ' ' WHEN 3 THEN chr(9) || chr(10) || chr(160) WHEN 4 THEN chr(8203) ELSE text END AS v FROM conversations)""")
def blank_cells(spark, d):
    k = F.col("turn") % 6
    v = F.when(k == 1, "").when(k == 2, "　 ").when(k == 3, "\t\n\xa0").when(k == 4, "​").when(k == 5, F.col("text"))
    t = _t(spark, d, "conversations").select("conv_id", "turn", v.alias("v"))
    return t.select("conv_id", "turn", is_empty(t, "v").alias("blank"), is_empty(t, "v", "sql").alias("sql_empty"))


_COMPARED = {"eq": ("o_orderstatus", "F", "="), "ne": ("o_orderstatus", "F", "<>"), "gt": ("o_totalprice", 150000.0, ">"), "lt": ("o_totalprice", 20000.0, "<"), "ge": ("o_custkey", 700, ">="), "le": ("o_custkey", 70, "<=")}


def _compare(op: str, column: str, value, sign: str) -> None:
    def run(spark, d):
        return predicates.filter_ids(_t(spark, d, "orders"), "o_orderkey", column, op, value)

    run.__name__ = f"filter_{op}"
    query(f"SELECT o_orderkey FROM orders WHERE {column} {sign} {value!r}")(run)


for _op, (_c, _v, _s) in _COMPARED.items():
    _compare(_op, _c, _v, _s)


def _derived_orders(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, None).when(F.col("o_orderkey") % 4 == 1, "  ").otherwise(F.col("o_orderpriority")).alias("note"))


_NOTE = "(SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE o_orderpriority END AS note FROM orders)"


@query(f"SELECT o_orderkey FROM {_NOTE} WHERE note IS NULL OR trim(note) = ''")
def filter_empty(spark, d):
    return predicates.filter_ids(_derived_orders(spark, d), "o_orderkey", "note", "empty")


@query(f"SELECT o_orderkey FROM {_NOTE} WHERE trim(note) <> ''")
def filter_not_empty(spark, d):
    return predicates.filter_ids(_derived_orders(spark, d), "o_orderkey", "note", "not_empty")


@query(f"SELECT o_orderkey FROM {_NOTE} WHERE note IS DISTINCT FROM '1-URGENT'")
def filter_ne_null_safe(spark, d):
    return predicates.filter_ids(_derived_orders(spark, d), "o_orderkey", "note", "ne", "1-URGENT", null_safe=True)


@query("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS qty FROM lineitem WHERE l_quantity > 25 AND l_discount <= 0.05 AND l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1")
def volume_filter(spark, d):
    t = _t(spark, d, "lineitem")
    kept = t.filter(predicates.condition(t, "l_quantity", "gt", 25) & predicates.condition(t, "l_discount", "le", 0.05) & (F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")))
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 100 AND 420")
def slice_range(spark, d):
    return predicates.id_range(_t(spark, d, "lineitem"), "l_orderkey", 100, 420).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN (7, 3, 1000000000, 12)")
def row_points(spark, d):
    return predicates.rows_at(_t(spark, d, "orders"), "o_orderkey", [7, 3, 1_000_000_000, 12]).select("o_orderkey", "o_custkey", "o_orderstatus")


# ---- projections, limits ----------------------------------------------------------------------------------------


@query(f"SELECT doc_id, text FROM {TASKS} WHERE {PENDING} ORDER BY doc_id LIMIT 25")
def sample_pending(spark, d):
    return predicates.sample_rows(_tasks(spark, d), SPEC, 25)


@query(f"SELECT doc_id, quality, toxic FROM {TASKS} WHERE quality IS NOT NULL AND toxic IS NOT NULL ORDER BY doc_id LIMIT 25")
def sample_processed(spark, d):
    return predicates.sample_rows(_tasks(spark, d), SPEC, 25, done=True)


@query(f"SELECT doc_id, coalesce(CAST(quality AS VARCHAR), '') AS quality, coalesce(CAST(n_chars AS VARCHAR), '') AS n_chars, CAST(NULL AS VARCHAR) AS note FROM {TASKS}")
def stringify_cells(spark, d):
    df = _tasks(spark, d)
    made = df.select("doc_id", to_text(df, "quality").alias("quality"), to_text(df, "n_chars").alias("n_chars"))
    return columns.add_column(made, "note")


@query("SELECT c_custkey, nullif(trim(c), '') AS known FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '   ' WHEN c_custkey % 3 = 1 THEN '  ' || c_name || ' ' ELSE c_mktsegment END AS c FROM customer)")
def known_texts(spark, d):
    c = F.when(F.col("c_custkey") % 3 == 0, "   ").when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("  "), "c_name", F.lit(" "))).otherwise(F.col("c_mktsegment"))
    return _t(spark, d, "customer").select("c_custkey", known_text(c).alias("known"))


@query("SELECT n_nationkey, n_name || ', ' || r_name AS people, r_name AS link FROM nation JOIN region ON n_regionkey = r_regionkey")
def nested_cells(spark, d):
    t = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    t = t.select("n_nationkey", F.array(F.struct(F.col("n_name").alias("name")), F.struct(F.col("r_name").alias("name"))).alias("a"), F.struct(F.lit(None).cast("string").alias("text"), F.col("r_name").alias("link")).alias("b"))
    return t.select("n_nationkey", to_text(t, "a").alias("people"), to_text(t, "b").alias("link"))


@query(f"SELECT doc_id, text FROM {TASKS} WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def reload_failed(spark, d):
    return predicates.all_rows(predicates.reload(_tasks(spark, d), _t(spark, d, "labels").where("toxic = 1"), "doc_id"), ["doc_id", "text", "gone"])


@query(f"SELECT quality, toxic FROM {TASKS} WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def processed_outputs(spark, d):
    return predicates.processed_rows(_tasks(spark, d), SPEC)


# ---- shards -----------------------------------------------------------------------------------------------------


@query("SELECT min(o_orderkey) AS min_id, max(o_orderkey) AS max_id, count(*) AS n_rows FROM orders")
def id_bounds(spark, d):
    return sharding.bounds(_t(spark, d, "orders"), "o_orderkey")


@query("WITH b AS (SELECT min(o_orderkey) AS lo0, max(o_orderkey) AS hi0 FROM orders) SELECT CAST(i AS INTEGER) AS shard, lo0 + i * 1000 AS lo, least(lo0 + i * 1000 + 999, hi0) AS hi FROM b, generate_series(0, (SELECT (hi0 - lo0) // 1000 FROM b)) s(i)")
def shard_ranges(spark, d):
    return sharding.shard_ranges(_t(spark, d, "orders"), "o_orderkey", 1000)


@query(f"SELECT doc_id // 100 AS shard, count(*) AS n_rows, count(*) FILTER (WHERE {PENDING}) AS n_pending FROM {TASKS} GROUP BY 1")
def shard_histogram(spark, d):
    df = _tasks(spark, d)
    return df.groupBy(sharding.shard_of(F.col("doc_id"), 0, 100).alias("shard")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(predicates.unprocessed(df, SPEC)).alias("n_pending"))


@query(f"SELECT doc_id, text FROM {TASKS} WHERE {PENDING} AND doc_id BETWEEN 100 AND 299")
def shard_load(spark, d):
    return sharding.load_shard(_tasks(spark, d), SPEC, 100, 299)


# ---- prompts and replies ----------------------------------------------------------------------------------------

TEMPLATE = "Rate this record: {record_json} Answer for {record_json} in JSON."


@query("""SELECT doc_id, replace('Rate this record: {record_json} Answer for {record_json} in JSON.', '{record_json}', CAST(to_json({'text': text, 'lang': lang, 'n_chars': n_chars}) AS VARCHAR)) AS prompt FROM documents""")
def prompt_render(spark, d):
    df = _t(spark, d, "documents").withColumn("_private", F.lit(1))
    return df.select("doc_id", prompt.render(TEMPLATE, prompt.record_json(df, ["text", "lang", "n_chars", "source", "_private"], exclude=["source"])).alias("prompt"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Be brief.' || chr(10) || text ELSE text END AS said, CASE WHEN role = 'user' THEN 2 ELSE 1 END AS n_messages FROM conversations WHERE text <> ''")
def message_text(spark, d):
    system = F.when(F.col("role") == "user", "Be brief.").otherwise("")
    t = _t(spark, d, "conversations").where("text <> ''")
    return t.select("conv_id", "turn", prompt.messages_text(system, F.col("text")).alias("said"), F.size(prompt.messages(system, F.col("text"))).alias("n_messages"))


_REPLY = "CASE turn % 4 WHEN 0 THEN 'Sure: ```JSON' || chr(10) || '{\"turn\": ' || turn || ', \"role\": \"' || role || '\",}' || chr(10) || '```' WHEN 1 THEN 'It is {\"turn\": ' || turn || '} I think, or {\"a\": 1}' WHEN 2 THEN '{\"turn\": ' || turn || ', \"role\": \"' || role || '\"}' ELSE text END"


def _replies(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", "role", F.expr(_REPLY.replace("chr(10)", "char(10)")).alias("reply"))


@query(f"SELECT conv_id, turn, regexp_extract(reply, '(?is)```(?:json)?\\s*(\\{{.*?\\}})\\s*```', 1) AS block FROM (SELECT conv_id, turn, {_REPLY} AS reply FROM conversations)")
def fence_extract(spark, d):
    return _replies(spark, d).select("conv_id", "turn", reply.fenced(F.col("reply")).alias("block"))


@query(f"SELECT conv_id, turn, regexp_replace(reply, ',\\s*([}}\\]])', '\\1', 'g') AS repaired FROM (SELECT conv_id, turn, {_REPLY} AS reply FROM conversations)")
def trailing_comma_repair(spark, d):
    return _replies(spark, d).select("conv_id", "turn", reply.without_trailing_commas(F.col("reply")).alias("repaired"))


@query(f"SELECT conv_id, turn, len(regexp_extract_all(reply, '(?s)(\\{{.*?\\}})', 1)) AS n, regexp_extract(reply, '(?s)(\\{{.*?\\}})', 1) AS first FROM (SELECT conv_id, turn, {_REPLY} AS reply FROM conversations)")
def object_candidates(spark, d):
    found = reply.object_candidates(F.col("reply"))
    return _replies(spark, d).select("conv_id", "turn", F.size(found).cast("bigint").alias("n"), F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("")).alias("first"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 IN (0, 2) AND role IN ('user', 'assistant') OR turn % 4 = 1 AND FALSE THEN '{"turn":' || turn || ',"role":"' || role || '"}' END AS data,
CASE WHEN turn % 4 IN (0, 2) THEN CASE WHEN role IN ('user', 'assistant') THEN NULL ELSE 'invalid_field_values' END WHEN turn % 4 = 3 AND text = '' THEN 'empty_ai_response' ELSE 'invalid_or_missing_json' END AS error FROM conversations""")
def parse_response(spark, d):
    said = reply.parse_reply(F.col("reply"), ["turn", "role"], {"role": ["user", "assistant"]})
    return _replies(spark, d).select("conv_id", "turn", said.alias("p")).select("conv_id", "turn", F.col("p.data_json").alias("data"), F.col("p.error").alias("error"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.ref') AS ref FROM events")
def parse_props(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.ref").alias("ref"))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS said FROM conversations GROUP BY 1")
def stream_texts(spark, d):
    event = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))))
    each = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", event.alias("e")))).alias("es"))
    stream = F.concat(F.array_join(F.transform("es", lambda x: x["e"]), "\n\n"), F.lit("\n\ndata: [DONE]\n"))
    return each.select("conv_id", reply.stream_text(stream).alias("said"))


@query("SELECT role, count(*) AS n, count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) AS n_bad FROM conversations GROUP BY 1")
def enum_validate(spark, d):
    t = _t(spark, d, "conversations")
    bad = F.size(validation.enum_errors(t, {"role": ["user", "assistant", 1], "absent": ["x"]})) > 0
    return t.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_bad"))


@query("SELECT event_id, list_sort(list_filter(['page', 'ref', 'nothing'], lambda x: NOT list_contains(json_keys(props), x))) AS missing FROM events")
def required_fields(spark, d):
    return _t(spark, d, "events").select("event_id", F.array_sort(validation.missing_fields(F.col("props"), ["page", "ref", "nothing"])).alias("missing"))


# ---- statistics -------------------------------------------------------------------------------------------------

_PICK = "v[CAST(least(floor(n * {p} / 100), n - 1) AS BIGINT) + 1] AS p{p}"
_STATS = "CAST(floor(CAST(s AS DOUBLE) / n * {total}) AS BIGINT) AS total_estimated, round(CAST(s AS DOUBLE) / n, 2) AS avg, v[1] AS min, v[n] AS max, " + ", ".join(_PICK.format(p=p) for p in (50, 90, 99)) + ", n AS sample_count"


@query(f"WITH x AS (SELECT list_sort(list(n_chars)) AS v, count(*) AS n, sum(n_chars)::BIGINT AS s FROM documents) SELECT {_STATS.format(total='n')} FROM x")
def token_stats(spark, d):
    return stats.token_stats(_t(spark, d, "documents"), "n_chars")


@query(f"""WITH y AS (SELECT length('Sys' || chr(10) || replace('Rate: {{record_json}}', '{{record_json}}', CAST(to_json({{'text': text}}) AS VARCHAR))) AS c FROM {TASKS} WHERE {PENDING} ORDER BY doc_id LIMIT 100),
x AS (SELECT list_sort(list(c)) AS v, count(*) AS n, sum(c)::BIGINT AS s FROM y) SELECT {_STATS.format(total=f"(SELECT count(*) FROM {TASKS} WHERE {PENDING})")} FROM x""")
def token_estimate_input(spark, d):
    return tokens.estimate(_tasks(spark, d), SPEC, "Rate: {record_json}", "Sys", "in", sample=100)["input_tokens"]


@query(f"""WITH y AS (SELECT length('Sys' || chr(10) || replace('Rate: {{record_json}}', '{{record_json}}', CAST(to_json({{'text': text}}) AS VARCHAR))) AS c FROM documents),
x AS (SELECT list_sort(list(c)) AS v, count(*) AS n, sum(c)::BIGINT AS s FROM y) SELECT {_STATS.format(total='n')} FROM x""")
def token_estimate_input_all(spark, d):
    # a row counts whatever its state, so the labels that tell it aren't joined
    return tokens.estimate(_t(spark, d, "documents"), SPEC, "Rate: {record_json}", "Sys", "in")["input_tokens"]


@query(f"""WITH y AS (SELECT length(CAST(to_json({{'quality': quality, 'toxic': toxic}}) AS VARCHAR)) AS c FROM {TASKS} WHERE quality IS NOT NULL AND toxic IS NOT NULL),
x AS (SELECT list_sort(list(c)) AS v, count(*) AS n, sum(c)::BIGINT AS s FROM y) SELECT {_STATS.format(total='n')} FROM x""")
def token_estimate_output(spark, d):
    return tokens.estimate(_tasks(spark, d), SPEC, "", mode="out")["output_tokens"]


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def error_type_counts(spark, d):
    return stats.error_counts(_t(spark, d, "events"), "event_type")


@query("SELECT user_id, sum(value * CASE WHEN k = 1 THEN 1 ELSE 0.1 END * power(0.9, c - k)) AS ema, count(*) AS n FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS c FROM events) GROUP BY 1")
def ema_latency(spark, d):
    return stats.ema(_t(spark, d, "events"), "user_id", "value", ["ts", "event_id"])


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INTEGER AS rank FROM events WHERE event_type = 'error') WHERE rank <= 5")
def error_history_last5(spark, d):
    errors = _t(spark, d, "events").where("event_type = 'error'")
    return stats.last_errors(errors, "user_id", ["ts", "event_id"], []).select("user_id", "event_id", "rank")


@query(f"SELECT CASE WHEN count(*) <= 0 THEN 100.0 ELSE CAST(count(*) FILTER (WHERE quality IS NOT NULL AND toxic IS NOT NULL) AS DOUBLE) / count(*) * 100 END AS percent FROM {TASKS}")
def progress(spark, d):
    return stats.counts(_tasks(spark, d), SPEC).select(stats.progress_percent(F.col("n_processed"), F.col("n_rows")).alias("percent"))


# ---- joins and merges -------------------------------------------------------------------------------------------


@query("SELECT coalesce(t, 'general') AS template, count(*) AS n FROM documents LEFT JOIN (VALUES ('en', 'english'), ('de', 'deutsch')) r(m, t) ON lang = m GROUP BY 1")
def route_counts(spark, d):
    known = routing.profiles(spark, {"prompt": {"template": "general"}}, [{"match": "en", "profile": {"prompt": {"template": "english"}}}, {"match": "de", "profile": {"prompt": {"template": "deutsch"}}}])
    return routing.route(_t(spark, d, "documents"), "lang", known, ["template"]).groupBy("template").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'old' WHEN l.toxic = 1 THEN 'ERROR: content_error - toxic' ELSE CAST(l.quality AS VARCHAR) END AS answer,
CASE WHEN l.toxic = 1 THEN 'ERROR: content_error - toxic' END AS extra FROM documents d LEFT JOIN labels l USING (doc_id)""")
def merge_results(spark, d):
    base = _t(spark, d, "documents").select("doc_id", F.lit("old").alias("answer"))
    results = _t(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("a"), F.when(F.col("toxic") == 1, "toxic").alias("_error"), F.lit("content_error").alias("_error_type"))
    return merge.write_back(base, results, TaskSpec(("answer",), {"a": "answer", "b": "extra"}, "doc_id"), on_failure="mark")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND l.toxic <> 1 THEN CAST(l.quality AS VARCHAR) ELSE 'old' END AS answer, CASE WHEN l.toxic <> 1 THEN '' END AS extra FROM documents d LEFT JOIN labels l USING (doc_id)")
def merge_skip_errors(spark, d):
    base = _t(spark, d, "documents").select("doc_id", F.lit("old").alias("answer"))
    results = _t(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("a"), F.when(F.col("toxic") == 1, "toxic").alias("_error"))
    return merge.write_back(base, results, TaskSpec(("answer",), {"a": "answer", "b": "extra"}, "doc_id"), missing="blank")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id * 2 FROM documents)")
def merge_unmatched(spark, d):
    return merge.unmatched(_t(spark, d, "documents").select((F.col("doc_id") * 2).alias("doc_id")), _t(spark, d, "labels").select("doc_id"), "doc_id")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def last_write_wins(spark, d):
    return merge.last_write(_t(spark, d, "events").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "event_id")


@query("""WITH u AS (SELECT user_id, event_type, CAST(arg_max(event_id, event_id) AS VARCHAR) AS v FROM events WHERE event_type IN ('view', 'error') GROUP BY 1, 2)
SELECT c_custkey, coalesce(v.v, 'x') AS view, e.v AS error FROM customer LEFT JOIN u v ON v.user_id = c_custkey AND v.event_type = 'view' LEFT JOIN u e ON e.user_id = c_custkey AND e.event_type = 'error'""")
def set_cells_batch(spark, d):
    base = _t(spark, d, "customer").select("c_custkey", F.lit("x").alias("view"), F.lit(None).cast("string").alias("error"))
    updates = _t(spark, d, "events").where("event_type in ('view', 'error', 'click')").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("column"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("seq"))
    return merge.set_cells(base, updates, "c_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey = 7 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def set_cell_one(spark, d):
    return merge.set_cell(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 7, "o_orderstatus", "X")


@query("SELECT o_custkey, min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) AS n FROM (SELECT o_custkey, o_orderkey, o_orderkey - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS g FROM orders) GROUP BY o_custkey, g")
def consecutive_groups(spark, d):
    return merge.consecutive(_t(spark, d, "orders"), "o_orderkey", ["o_custkey"])


@query("SELECT min(doc_id) AS lo, max(doc_id) AS hi, count(*) AS n FROM (SELECT doc_id, doc_id - row_number() OVER (ORDER BY doc_id) AS g FROM labels) GROUP BY g")
def consecutive_rows(spark, d):
    return merge.consecutive(_t(spark, d, "labels"), "doc_id", block=64)


# ---- retries and dispatch ---------------------------------------------------------------------------------------

_ERRORS = "(SELECT user_id, event_id, CASE event_id % 3 WHEN 0 THEN 'api_error' WHEN 1 THEN 'content_error' ELSE 'system_error' END AS kind, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts, event_id) - 1 AS retries, event_id % 5 AS since FROM events WHERE event_type = 'error')"


@query(f"""SELECT event_id, CASE WHEN retries >= lim THEN 'fail' WHEN kind = 'api_error' AND since > 2 THEN 'pause' ELSE 'retry' END AS action, retries < lim AND kind <> 'content_error' AS reload
FROM (SELECT *, CASE kind WHEN 'api_error' THEN 3 WHEN 'content_error' THEN 2 ELSE 1 END AS lim FROM {_ERRORS})""")
def retry_decision(spark, d):
    e = _t(spark, d, "events").where("event_type = 'error'")
    kind = F.element_at(F.array(F.lit("api_error"), F.lit("content_error"), F.lit("system_error")), (F.col("event_id") % 3 + 1).cast("int"))
    order = Window.partitionBy("user_id", F.col("event_id") % 3).orderBy("ts", "event_id")
    log = e.select("event_id", kind.alias("kind"), (F.row_number().over(order) - 1).alias("retries"), (F.col("event_id") % 5).alias("since"))
    return log.select("event_id", infer.decision(F.col("kind"), F.col("retries"), F.col("since"), {"api_error": 3, "content_error": 2}, 2).alias("d")).select("event_id", "d.action", "d.reload")


@query("SELECT user_id, n AS fails, CASE WHEN n <= 3 THEN 2.0 * n ELSE least(6 + power(2.0, n - 3), 60.0) END AS seconds FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)")
def backoff_schedule(spark, d):
    n = _t(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("fails"))
    return n.withColumn("seconds", dispatch.backoff_seconds(F.col("fails")))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, k, t, 4.0::DOUBLE - 1 AS tokens, 1 AS ok FROM e WHERE k = 1
 UNION ALL SELECT e.user_id, e.k, e.t, CASE WHEN least(4.0, r.tokens + (e.t - r.t) * 2e-5) >= 1 THEN least(4.0, r.tokens + (e.t - r.t) * 2e-5) - 1 ELSE least(4.0, r.tokens + (e.t - r.t) * 2e-5) END, CASE WHEN least(4.0, r.tokens + (e.t - r.t) * 2e-5) >= 1 THEN 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, sum(ok)::BIGINT AS n_admitted, count(*) AS n FROM r GROUP BY 1""")
def token_bucket_admitted(spark, d):
    e = _t(spark, d, "events").select("user_id", _seconds("ts").alias("t"), "event_id")
    said = dispatch.token_bucket(e, "user_id", "t", "event_id", rps=2e-5, capacity=4.0)
    return said.groupBy("user_id").agg(F.count_if(F.col("admitted")).alias("n_admitted"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) FILTER (WHERE value >= 20) AS n_ok, count(*) FILTER (WHERE value < 20) AS n_failed, CAST(count(*) FILTER (WHERE value >= 20) AS DOUBLE) / count(*) AS rate FROM events GROUP BY 1")
def success_rate(spark, d):
    return dispatch.success_rates(_t(spark, d, "events"), "event_type", F.col("value") >= 20)


@query("SELECT CASE WHEN a = 0 THEN 'unhealthy' WHEN a < t THEN 'degraded' ELSE 'healthy' END AS status, a AS available_models, t AS total_models FROM (SELECT count(*) FILTER (WHERE n_err < 30) AS a, count(*) AS t FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n_err FROM events GROUP BY 1))")
def health_status(spark, d):
    states = _t(spark, d, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") < 30).alias("usable"))
    return dispatch.health(states)


_UNIT = "(CAST('0x' || substr(md5('0:' || doc_id), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE)"


@query(f"SELECT doc_id, CASE WHEN {_UNIT} * 10 < 5 THEN 'a' WHEN {_UNIT} * 10 < 8 THEN 'b' ELSE 'd' END AS picked FROM documents")
def weighted_pick(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", dispatch.weighted_pick(dispatch.hash_unit(F.col("doc_id")), [("a", 5), ("b", 3), ("c", 0), ("d", 2)]).alias("picked"))


_MODELS = [{"id": "m1", "name": "small", "model": "s-1", "weight": 5}, {"id": "m2", "name": "large", "model": "l-1", "weight": 3}, {"id": "m3", "name": "small", "model": "s-1", "weight": 2}, {"id": "m4", "name": "off", "model": "o-1", "weight": 0}]


@query(f"""SELECT doc_id, CASE lang WHEN 'de' THEN 'm2' WHEN 'fr' THEN 'm3' ELSE CASE WHEN {_UNIT} * 10 < 5 THEN 'm1' WHEN {_UNIT} * 10 < 8 THEN 'm2' ELSE 'm3' END END AS picked
FROM documents""")
def preferred_model(spark, d):
    asked = F.when(F.col("lang") == "de", "large").when(F.col("lang") == "fr", "small").when(F.col("lang") == "es", "off").otherwise("auto")
    known = dispatch.models(spark, _MODELS)
    wanted = dispatch.resolve(_t(spark, d, "documents").select("doc_id", asked.alias("asked")), "asked", known)
    return dispatch.pick_model(wanted, "doc_id", known, wanted="wanted").select("doc_id", "picked")


@query("""SELECT exposed_id, arg_min(id, position) AS id FROM (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_suppkey AS position,
CASE WHEN s_nationkey % 3 = 0 THEN 'shown ' || s_nationkey WHEN s_nationkey % 3 = 1 THEN 'm' || s_nationkey % 5 ELSE CAST(s_suppkey AS VARCHAR) END AS exposed_id FROM supplier WHERE s_acctbal > 0) GROUP BY 1""")
def exposed_models(spark, d):
    nation = F.col("s_nationkey")
    name = F.when(nation % 3 == 0, F.concat(F.lit("shown "), nation.cast("string"))).otherwise("")
    known = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), name.alias("name"), F.when(nation % 3 == 1, F.concat(F.lit("m"), (nation % 5).cast("string"))).alias("model"), F.greatest("s_acctbal", F.lit(0.0)).alias("weight"), F.col("s_suppkey").alias("position"))
    return dispatch.exposed_models(known)


@query("SELECT c_custkey, CAST(c_custkey % 3 AS INTEGER) AS turn, list_concat(l[c_custkey % 3 + 1:], l[:c_custkey % 3]) AS ips FROM (SELECT c_custkey, ['1.1.1.1', '2.2.2.2', '3.3.3.3'] AS l FROM customer)")
def rotate_addresses(spark, d):
    l = F.array(F.lit("1.1.1.1"), F.lit("2.2.2.2"), F.lit("3.3.3.3"))  # noqa: E741
    return _t(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 3).cast("int").alias("turn"), dispatch.rotate(l, F.col("c_custkey") % 3).alias("ips"))


@query("""SELECT host, list(ip ORDER BY first_page) AS ips FROM (SELECT regexp_extract(url, '://([^/?#:]+)', 1) AS host, '10.0.' || (page_id % 7) || '.1' AS ip, min(page_id) AS first_page FROM pages WHERE page_id % 5 <> 0 GROUP BY 1, 2) GROUP BY 1""")
def ip_pool_merge(spark, d):
    pool = F.array(F.concat(F.lit("10.0."), (F.col("page_id") % 7).cast("string"), F.lit(".1")), F.lit("not an ip"), F.lit("300.1.1.1"))
    channels = _t(spark, d, "pages").select(F.col("url").alias("base_url"), pool.alias("ip_pool"), F.when(F.col("page_id") % 5 == 0, "proxy").alias("proxy"), F.col("page_id").alias("position"))
    return dispatch.ip_pools(channels).select("host", "ips")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, greatest(0.5, least(s_suppkey / 10.0, 10.0)) AS rps FROM supplier")
def default_rates(spark, d):
    return _t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), dispatch.default_rps(F.col("s_suppkey").cast("double")).alias("rps"))


@query("""SELECT event_type AS model, count(*) FILTER (WHERE value >= 20) AS n_ok, count(*) FILTER (WHERE value < 20) AS n_failed, count(*) FILTER (WHERE value >= 20) / count(*)::DOUBLE AS rate, avg(value) AS avg_seconds,
count(*) FILTER (WHERE value < 20 AND event_id > coalesce(last_ok, -1)) AS last_fails FROM (SELECT *, max(event_id) FILTER (WHERE value >= 20) OVER (PARTITION BY event_type) AS last_ok FROM events) GROUP BY 1""")
def model_stats(spark, d):
    log = _t(spark, d, "events").select(F.col("event_type").alias("model"), (F.col("value") >= 20).alias("ok"), F.col("value").alias("seconds"), F.col("event_id").alias("ts"))
    return dispatch.model_stats(log)


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN NULL ELSE length(text) END AS answer, CASE WHEN doc_id % 10 = 3 THEN 'content_error' END AS error_type, CASE WHEN doc_id % 10 = 3 THEN 2 ELSE 1 END AS attempts FROM documents")
def infer_documents(spark, d):
    df = _t(spark, d, "documents")
    rows = df.select("doc_id", prompt.render("{record_json}", prompt.record_json(df, ["doc_id", "text"])).alias("prompt"))

    def answer(messages):
        said = json.loads(messages[-1]["content"])
        text = said.get("text")
        return "no idea" if said["doc_id"] % 10 == 3 else json.dumps({"answer": None if text is None else len(text)})

    out = infer.infer(rows, lambda: infer.FakeClient(answer), ["doc_id"], ["answer"], retry=infer.Retry(pause=0.0))
    return out.select("doc_id", F.get_json_object("reply_json", "$.answer").cast("int").alias("answer"), F.col("_error_type").alias("error_type"), "attempts")


# ---- sources and sinks: written, read back --------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, or temporary for a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='tablemill-')}"
    return f"{shared.rstrip('/')}/tables-{uuid.uuid4().hex}"


def _local_folder(spark: SparkSession) -> str:
    """The same as a plain path, for formats that are one file of the local file system."""
    path = _folder(spark).removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError(f"{path} isn't in the local file system")
    os.makedirs(path)
    return path


_EVENTS = "SELECT event_id, user_id, event_type, value, props FROM events"


def _stored(kind: str) -> None:
    def run(spark, d):
        path = f"{_folder(spark)}/events.{kind}"
        files.write(_t(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props"), path)
        return open_source(spark, {"type": kind, "input_path": path}).select("event_id", "user_id", "event_type", "value", "props")

    run.__name__ = f"{kind}_round_trip"
    query(_EVENTS)(run)


for _kind in ("parquet", "json", "orc"):
    _stored(_kind)


@query("SELECT doc_id, nullif(text, '') AS text, lang, n_chars, '  ' || lang || ' ' AS spaced FROM documents")
def csv_round_trip(spark, d):
    path = f"{_folder(spark)}/documents.csv"
    files.write(_t(spark, d, "documents").select("doc_id", "text", "lang", "n_chars", F.concat(F.lit("  "), "lang", F.lit(" ")).alias("spaced")), path)
    out = files.read(spark, path, schema="doc_id bigint, text string, lang string, n_chars bigint, spaced string")
    return out.withColumn("text", F.nullif("text", F.lit("")))


@query("SELECT event_id, user_id, event_type, value FROM events")
def csv_types_inferred(spark, d):
    path = f"{_folder(spark)}/events.csv"
    files.write(_t(spark, d, "events").select("event_id", "user_id", "event_type", "value"), path)
    got = open_source(spark, {"type": "csv", "input_path": path, "options": {"multiLine": False}})
    return got.select(F.col("event_id").cast("bigint"), F.col("user_id").cast("bigint"), "event_type", "value")


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment || chr(10) || '<&\"' END AS note FROM customer")
def xlsx_round_trip(spark, d):
    path = f"{_local_folder(spark)}/customers.xlsx"
    note = F.when(F.col("c_custkey") % 3 != 0, F.concat("c_mktsegment", F.lit('\n<&"')))
    files.write(_t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", note.alias("note")), path)
    got = open_source(spark, {"type": "excel", "input_path": path})
    return got.select(F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("bigint"), F.col("c_acctbal").cast("double"), "note")


def _database(spark: SparkSession, d: str) -> str:
    """A store of one file with a row per customer and no answers, filled row by row, as such a store is."""
    path = f"{_local_folder(spark)}/tasks.db"
    source = _t(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("question"))
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE tasks (id INTEGER PRIMARY KEY, name TEXT, question TEXT, answer TEXT)")
        c.executemany("INSERT INTO tasks VALUES (?, ?, ?, NULL)", (tuple(r) for r in columns.rows(source)))
    c.close()
    return path


def _answered(spark: SparkSession, d: str) -> str:
    path = _database(spark, d)
    open_source(spark, {"type": "sqlite", "db_path": path, "table_name": "tasks"})
    answers = _t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("int").cast("string").alias("answer"))
    answers.write.format("sqlite_table").options(path=path, table="tasks").mode("append").save()
    return path


_TASK_ROWS = "(SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS question, CASE WHEN c_acctbal > 0 THEN CAST(CAST(trunc(c_acctbal) AS INTEGER) AS VARCHAR) END AS answer FROM customer)"


@query(f"SELECT id, name, question, answer FROM {_TASK_ROWS}")
def sqlite_round_trip(spark, d):
    return open_source(spark, {"type": "sqlite", "db_path": _answered(spark, d), "table_name": "tasks"})


@query(f"SELECT id, question FROM {_TASK_ROWS} WHERE question IS NOT NULL AND question <> '' AND (answer IS NULL OR answer = '')")
def sqlite_pending(spark, d):
    from tablemill.sources import sqlite

    return sqlite.pending(spark, _answered(spark, d), "tasks", TaskSpec(("question",), {"a": "answer"})).select("id", "question")


@query("SELECT doc_id, quality + 1 AS quality, toxic FROM labels")
def overwrite_in_place(spark, d):
    path = f"{_folder(spark)}/labels.parquet"
    files.write(_t(spark, d, "labels"), path)
    old = files.read(spark, path)
    files.write(old.withColumn("quality", F.col("quality") + 1), path)
    return files.read(spark, path).select("doc_id", "quality", "toxic")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents")
def row_ids(spark, d):
    return files.with_row_ids(_t(spark, d, "documents"), "row_id").select("doc_id", "row_id")


@query("SELECT doc_id, 'a' || chr(65533) || CAST(doc_id AS VARCHAR) AS cell FROM labels")
def unencodable_cells(spark, d):
    bad = F.concat(F.lit(b"a\xff"), F.col("doc_id").cast("string").cast("binary")).cast("string")
    return files.clean_text(_t(spark, d, "labels").select("doc_id", bad.alias("cell")))


# ---- predicates as SQL text, projections, configuration -----------------------------------------------------------------


_TURNS = "(SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN '' WHEN turn % 3 = 0 THEN role END AS out FROM conversations)"


def _turns(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", "text", F.when(F.col("role") == "user", "").when(F.col("turn") % 3 == 0, F.col("role")).alias("out"))


@query(f"SELECT conv_id, turn, coalesce(text, '') <> '' AND coalesce(out, '') = '' AS pending, coalesce(out, '') <> '' AS done FROM {_TURNS}")
def predicates_as_sql(spark, d):
    spec = TaskSpec(("text",), {"out": "out"}, "conv_id", mode="sql")
    return _turns(spark, d).select("conv_id", "turn", F.expr(predicates.unprocessed_sql(spec)).alias("pending"), F.expr(predicates.processed_sql(spec)).alias("done"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def row_point(spark, d):
    t = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    last = sharding.bounds(t, "o_orderkey").first()["max_id"]
    return spark.createDataFrame([predicates.row_at(t, "o_orderkey", last)], t.schema)


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, coalesce(o_orderpriority, '') AS o_orderpriority FROM orders")
def project_inputs(spark, d):
    return columns.project(_t(spark, d, "orders"), TaskSpec(("o_custkey", "o_orderpriority", "not_there"), {"a": "a"}, "o_orderkey"), as_text=True)


@query("SELECT doc_id, quality AS ai_quality, toxic, CAST(NULL AS VARCHAR) AS note FROM labels")
def physical_names(spark, d):
    spec = TaskSpec(("quality",), {"quality": "ai_quality", "note": "note"}, "doc_id")
    return columns.with_outputs(columns.to_physical(_t(spark, d, "labels"), spec.outputs), spec).select("doc_id", "ai_quality", "toxic", "note")


@query("SELECT o_orderkey FROM orders")
def all_ids(spark, d):
    return columns.ids(_t(spark, d, "orders"), "o_orderkey")


@query("SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN [text] END AS stop, [text, role] AS stops FROM conversations")
def stop_lists(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", prompt.stop_list(F.col("text"), False).alias("stop"), prompt.stop_list(F.array("text", "role"), True).alias("stops"))


def _rule_table(spark, d):
    """A row per field and value that it may have, as a store of rules holds them."""
    values = [_t(spark, d, "conversations").select(F.lit("role").alias("field"), F.col("role").alias("value")), _t(spark, d, "documents").select(F.lit("lang"), "lang"), _t(spark, d, "orders").select(F.lit("status"), "o_orderstatus")]
    return values[0].unionByName(values[1].toDF("field", "value")).unionByName(values[2].toDF("field", "value"))


_RULE_ROWS = "(SELECT DISTINCT 'role' AS field, role AS value FROM conversations UNION ALL SELECT DISTINCT 'lang', lang FROM documents UNION ALL SELECT DISTINCT 'status', o_orderstatus FROM orders)"


@query(f"SELECT field, CAST(count(*) AS INTEGER) AS n_values FROM {_RULE_ROWS} GROUP BY 1")
def rule_sizes(spark, d):
    rules = validation.rules_from(_rule_table(spark, d))
    return spark.createDataFrame(list(validation.rule_sizes(rules).items()), "field string, n_values int")


@query(f"""SELECT '{{"type":"object","properties":{{"note":{{"type":"string"}},' || string_agg('"' || field || '":{{"type":"string","enum":[' || vs || ']}}', ',' ORDER BY field) || '}},"required":["note",' || string_agg('"' || field || '"', ',' ORDER BY field) || ']}}' AS schema
FROM (SELECT field, string_agg('"' || value || '"', ',' ORDER BY value) AS vs FROM {_RULE_ROWS} GROUP BY 1)""")
def json_schema(spark, d):
    rules = validation.rules_from(_rule_table(spark, d))
    return spark.createDataFrame([(json.dumps(validation.json_schema(["note", *sorted(rules)], rules), separators=(",", ":")),)], "schema string")


@query("SELECT p_partkey, greatest(1000, least(CAST(floor(p_retailprice * 0.3::DOUBLE * 1024 / 5) AS INTEGER), CASE WHEN p_size > 5 THEN CAST(floor((p_size - 5) / 4.0::DOUBLE * 900) AS INTEGER) ELSE 50000 END, 10000, 50000))::INTEGER AS size FROM part")
def shard_sizes(spark, d):
    return _t(spark, d, "part").select("p_partkey", sharding.shard_size_of(F.col("p_retailprice"), (F.col("p_size") - 5) / 4.0).alias("size"))


@query("SELECT n_name AS model, CAST(n_nationkey AS INTEGER) AS batch_size, 3 AS api_retries, CAST(n_regionkey AS INTEGER) AS content_retries, 2.0::DOUBLE AS pause, 'io' AS mode, [n_name] AS inputs, ['x_out'] AS outputs FROM nation")
def config_merge(spark, d):
    """A configuration for each row of a small table, merged over the defaults."""
    out = []
    for name, key, region in map(tuple, _t(spark, d, "nation").select("n_name", "n_nationkey", "n_regionkey").collect()):
        c = configured({"datasource": {"concurrency": {"batch_size": key, "retry_limits": {"content_error": region}}}, "columns_to_extract": [name], "columns_to_write": {"x": "x_out"}, "prompt": {"model": name}})
        limits, spec = c["datasource"]["concurrency"], spec_of(c)
        out.append((c["prompt"]["model"], limits["batch_size"], limits["retry_limits"]["api_error"], limits["retry_limits"]["content_error"], limits["api_pause_duration"], c["token_estimation"]["mode"], list(spec.inputs), spec.output_columns))
    return spark.createDataFrame(out, "model string, batch_size int, api_retries int, content_retries int, pause double, mode string, inputs array<string>, outputs array<string>")


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '{"a":{"b":' || turn || '},"c":"}"}' END AS data FROM conversations""")
def nested_objects(spark, d):
    """Objects that hold others, in prose."""
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('I think { that {"a":{"b":'), F.col("turn").cast("string"), F.lit('},"c":"}"} is right. '), F.col("role"))).otherwise(F.concat(F.lit("no {object} "), "role"))
    found = _t(spark, d, "conversations").select("conv_id", "turn", reply.parse_reply(said, ["a"], nested=True).alias("r"))
    return found.select("conv_id", "turn", F.col("r.data_json").alias("data"))


@query()
def token_estimate_by_vocabulary(spark, d):
    """Tokens of inputs and outputs by a vocabulary file, as the configuration says; no SQL knows the vocabulary."""
    import public_tokenizers

    said = {"mode": "io", "vocabulary": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    config = {"datasource": {"id_col": "doc_id"}, "columns_to_extract": ["text"], "columns_to_write": {"quality": "quality", "toxic": "toxic"}, "prompt": {"template": TEMPLATE}, "token_estimation": said}
    both = Enrichment(spark, config, lambda: None, "").tokens(_tasks(spark, d))
    return both["input_tokens"].withColumn("side", F.lit("input")).unionByName(both["output_tokens"].withColumn("side", F.lit("output")))


# ---- models, a whole run ------------------------------------------------------------------------------------------------


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, 'http://' || CAST(n_nationkey AS VARCHAR) AS base_url, least(s_suppkey % 50 + 1, n_nationkey + 5)::DOUBLE AS timeout FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def model_channels(spark, d):
    known = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_nationkey").cast("string").alias("channel_id"), (F.col("s_suppkey") % 50 + 1).cast("double").alias("timeout"))
    key = F.col("n_nationkey").cast("string")
    channels = _t(spark, d, "nation").select(key.alias("id"), F.concat(F.lit("http://"), key).alias("base_url"), (F.col("n_nationkey") + 5).cast("double").alias("timeout"))
    return dispatch.with_channels(known, channels).select("id", "base_url", "timeout")


@query("""WITH f AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n, max(epoch_us(ts) / 1000000.0::DOUBLE) FILTER (WHERE event_type = 'error') AS t, (SELECT max(epoch_us(ts) / 1000000.0::DOUBLE) FROM events) AS latest FROM events GROUP BY 1)
SELECT user_id, coalesce(latest >= t + CASE WHEN n <= 0 THEN 0 WHEN n <= 3 THEN n * 2 ELSE least(6 + power(2.0, n - 3), 60.0) END, true) AS available FROM f""")
def availability(spark, d):
    failed = F.when(F.col("event_type") == "error", _seconds("ts"))
    states = _t(spark, d, "events").groupBy("user_id").agg(F.count(failed).alias("n"), F.max(failed).alias("t"), F.max(_seconds("ts")).alias("last"))
    now = states.agg(F.max("last")).first()[0]
    return states.select("user_id", dispatch.available(F.col("t") + dispatch.backoff_seconds(F.col("n")), F.lit(now)).alias("available"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN value ELSE 0.7::DOUBLE END AS temperature, CASE WHEN user_id % 2 = 0 THEN value / 2 END AS top_p FROM events")
def request_parameters(spark, d):
    asked = F.when(F.col("event_type") == "view", F.col("value"))
    return _t(spark, d, "events").select("event_id", *[c.alias(n) for n, c in dispatch.request_params(asked, F.lit(0.7), {"top_p": F.col("value") / 2}, F.col("user_id") % 2 == 0).items()])


def _run(spark, d):
    source = _t(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 5 == 0, "done").alias("answer"))

    def said(messages):
        n = len(json.loads(messages[-1]["content"])["text"])
        return "no idea" if n % 7 == 0 else json.dumps({"n": str(n)})

    config = {"datasource": {"id_col": "doc_id", "concurrency": {"retry_limits": {"content_error": 1}, "api_pause_duration": 0.0}}, "columns_to_extract": ["text"], "columns_to_write": {"n": "answer"}, "prompt": {"template": "{record_json}", "required_fields": ["n"]}}
    return Enrichment(spark, config, lambda: infer.FakeClient(said), _folder(spark)).run(source, on_failure="leave")


_DONE = f"(SELECT doc_id, doc_id % 5 = 0 AS done, {VALID} AS valid, length(text) AS n FROM documents)"


@query(f"SELECT doc_id, CASE WHEN done THEN 'done' WHEN NOT valid OR n % 7 = 0 THEN NULL ELSE CAST(n AS VARCHAR) END AS answer FROM {_DONE}")
def enrich_run(spark, d):
    return _run(spark, d)[0].select("doc_id", "answer")


@query(f"SELECT count(*) AS n_tasks, count(*) FILTER (WHERE n % 7 <> 0) AS n_ok, count(*) FILTER (WHERE n % 7 = 0) AS n_failed, count(*) FILTER (WHERE n % 7 = 0) AS n_retries, count(*) FILTER (WHERE n % 7 <> 0) / count(*)::DOUBLE AS success_rate, 0::BIGINT AS n_api_error, count(*) FILTER (WHERE n % 7 = 0) AS n_content_error, 0::BIGINT AS n_system_error FROM {_DONE} WHERE valid AND NOT done")
def enrich_figures(spark, d):
    return _run(spark, d)[1]


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'mended ' || lang ELSE lang || ' ' || length(text) END AS answer,
CASE WHEN doc_id % 11 = 0 THEN 'api_error' END AS error_type, CASE WHEN doc_id % 11 = 0 THEN 3 WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS attempts FROM documents""")
def retry_reload(spark, d):
    """Rows that fail are read from their source again; it is mended while all tasks pause."""
    path = f"{_folder(spark)}/tasks.parquet"
    docs = _t(spark, d, "documents").select("doc_id", "lang", F.length("text").cast("string").alias("n"))
    files.write(docs.withColumn("q", F.when(F.col("doc_id") % 7 == 0, "broken").when(F.col("doc_id") % 11 == 0, "down").otherwise(F.concat("lang", F.lit(" "), "n"))), path)

    def mend(_: float) -> None:
        rows = files.read(spark, path)
        files.write(rows.withColumn("q", F.when(F.col("doc_id") % 11 == 0, "down").when(F.col("q") == "broken", F.concat(F.lit("mended "), "lang")).otherwise(F.col("q"))), path)

    def said(messages):
        q = json.loads(messages[-1]["content"])["q"]
        if q in ("broken", "down"):
            raise infer.ApiError(q)
        return json.dumps({"a": q})

    config = {"datasource": {"type": "parquet", "input_path": path, "id_col": "doc_id", "concurrency": {"retry_limits": {"api_error": 2}, "api_pause_duration": 1.0}}, "columns_to_extract": ["q"], "columns_to_write": {"a": "answer"}, "prompt": {"template": "{record_json}", "required_fields": ["a"]}}
    plan = Enrichment(spark, config, lambda: infer.FakeClient(said), _folder(spark))
    out = plan.replies_in_rounds(lambda: files.read(spark, path), sleep=mend)
    return out.select("doc_id", F.get_json_object("reply_json", "$.a").alias("answer"), F.col("_error_type").alias("error_type"), "attempts")
