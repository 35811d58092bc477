"""The queries that apply each operator to its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm.bpe import bpe_decode, bpe_encode
from tablemill.llm.common import WORD, shared_dir, table, text_of
from tablemill.llm.conversation import repair_report, repaired_pieces
from tablemill.llm.exact_dedup import exact_dedup
from tablemill.llm.mixing import mix
from tablemill.llm.ngram_join import ngram_join
from tablemill.llm.periodic import periodic_runs
from tablemill.llm.pii import ALL, pii_spans
from tablemill.llm.pii import BASE as PII_BASE
from tablemill.llm.pii import fit as fit_pii
from tablemill.llm.quality import quality_rules
from tablemill.llm.secrets import BASE, secret_spans
from tablemill.llm.substring_dedup import repeated_spans
from tablemill.llm.token_count import library_encoder, token_counts, tokenizers_pattern
from tablemill.llm.token_files import read_token_files, write_token_files
from tablemill.llm.url_filter import ABOVE, APART, BELOW, LEVELS, MIN_CHILDREN, MIN_SPREAD, NEAR, REJECT, RULES, SMOOTHING, SPREAD, url_filter

QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe_encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=["doc_id"])
    return bpe_decode(ids, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


ORACLES["op2_exact_dedup"] = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm)
"""


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"), keep=["doc_id"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


_WORD = r"[^\x20\x09-\x0D]+"
_RULES = {"short": "n_words < 20", "repeats": "n_repeat_words * 100 > n_words * 30", "symbols": "n_symbols * 100 > word_chars * 10", "dup_lines": "n_dup_lines > 10"}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES["op4_quality_rules"] = f"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM w, generate_series(1, len(ws) - 7) s(i)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, generate_series(0, 7) s(k) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM w),
m AS (SELECT doc_id, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
h AS (SELECT source, count(*)::DOUBLE AS n, {", ".join(f"count(*) FILTER (WHERE {c})::DOUBLE AS f_{r}" for r, c in _RULES.items())} FROM m WHERE source IS NOT NULL GROUP BY source),
a AS (SELECT count(*) AS hosts, sum(n) AS n_all, sum(n * n) AS n2, {", ".join(f"sum(f_{r}) / sum(n) AS m_{r}, sum(f_{r} * f_{r} / n) AS q_{r}" for r in _RULES)} FROM h),
b AS (SELECT *, n_all - n2 / n_all AS free, {", ".join(f"q_{r} - n_all * m_{r} * m_{r} - (hosts - 1) * m_{r} * (1 - m_{r}) AS e_{r}" for r in _RULES)} FROM a),
p AS (SELECT {", ".join(f"m_{r}, greatest(6.0::DOUBLE * m_{r} / (1 - m_{r} + 6.0::DOUBLE * m_{r}), 0.25::DOUBLE) AS l_{r}, CASE WHEN free > 0 AND e_{r} > 0 THEN least(greatest(m_{r} * (1 - m_{r}) / (e_{r} / free) - 1, 0.01::DOUBLE), 1e9) ELSE 1e9 END AS k_{r}" for r in _RULES)} FROM b),
s AS (SELECT source, n, {", ".join(f"(f_{r} + m_{r} * k_{r}) / (n + k_{r}) AS s_{r}, k_{r}, l_{r}" for r in _RULES)} FROM h, p),
v AS (SELECT source, {", ".join(f"round(s_{r}, 6) AS rate_{r}" for r in _RULES)}, {" OR ".join(f"s_{r} - sqrt(greatest(s_{r} * (1 - s_{r}), 0) / (n + k_{r} + 1)) * 2.33::DOUBLE >= l_{r}" for r in _RULES)} AS bad FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_RULES["short"]} OR {_RULES["repeats"]} AS base_failed,
  NOT ({_RULES["short"]} OR {_RULES["repeats"]}) AND NOT coalesce(bad, false) AS kept, {", ".join(f"rate_{r}" for r in _RULES)}, coalesce(bad, false) AS host_rejected FROM m LEFT JOIN v USING (source)
"""


@query
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


ORACLES["op5_ngram_join"] = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
w AS (SELECT r, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM d),
s AS (SELECT DISTINCT r, array_to_string(ws[i:i + 4], ' ') AS g FROM w, generate_series(1, greatest(1, len(ws) - 4)) x(i) WHERE len(ws) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE c::DOUBLE / (p.n + q.n - c) >= 0.8),
u AS (SELECT r, r AS m FROM d UNION SELECT u.r, e.y FROM u JOIN e ON u.m = e.x),
k AS (SELECT u.r, min(o.doc_id) AS class_id FROM u JOIN d o ON o.r = u.m GROUP BY u.r)
SELECT d.doc_id, class_id, coalesce(l.n_links, 0) AS n_links, coalesce(n.n, 0)::INTEGER AS n_shingles
FROM d JOIN k USING (r) LEFT JOIN n USING (r) LEFT JOIN (SELECT x, count(*) AS n_links FROM e GROUP BY x) l ON l.x = d.r
"""


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), tokenizers_pattern()
    files = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), files, lambda: library_encoder(path, pattern), end_id=2)
    return read_token_files(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLES["op7_mixing"] = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size, CAST('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 15) AS BIGINT) AS spin FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / w AS ratio, row_number() OVER o AS n, (sum(source_size) OVER ()::DOUBLE * 1.5 - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
f AS (SELECT min(n) FILTER (WHERE level < ratio) AS first, arg_min(level, n) FILTER (WHERE level < ratio) AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN f.first IS NULL OR n < f.first THEN cap ELSE f.level * w END AS target FROM l, f),
a AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
x AS (SELECT d.*, source_size, target, whole, greatest(0, round_even(target, 0)::BIGINT - whole * source_size) AS extra,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY spin, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
y AS (SELECT *, greatest(0, least(size, extra - before)) AS more FROM x)
SELECT doc_id, size, source_size, target, whole * size + more AS taken, (CASE WHEN size > 0 THEN whole ELSE 0 END + CASE WHEN more = size AND size > 0 THEN 1 ELSE 0 END)::INTEGER AS epochs,
  CASE WHEN more = size AND size > 0 THEN 0 ELSE more END AS part FROM y
"""


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512, keep=["doc_id"])


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), (F.col("quality") == 0).alias("bad"))
    return url_filter(table(spark, sf_dir, "pages"), labels).drop("bad_share")


_FITS = "(r.host = '{h}' OR ends_with(r.host, '.{h}')) AND starts_with(path, '{p}')"
_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[0] + r[1]))

ORACLES["op10_url_filter"] = rf"""
WITH RECURSIVE u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
q AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' || regexp_extract(x, '\.[A-Za-z]{{1,8}}$') ELSE x END) AS plain,
  TRY_CAST(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS num FROM hp),
r AS (SELECT *, CASE WHEN len(plain) > {LEVELS} THEN list_append(plain[1:{LEVELS - 1}], array_to_string(plain[{LEVELS}:], '/')) ELSE plain END AS shape FROM q),
lab AS (SELECT doc_id AS num, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY 1),
known AS (SELECT host, shape, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM r LEFT JOIN lab USING (num) GROUP BY 1, 2),
g AS (SELECT host, shape, n, 0 AS d, '' AS node FROM known UNION ALL
  SELECT host, shape, n, d + 1, node || '/' || CASE WHEN kinds >= {MIN_CHILDREN} AND kinds >= pages * {MIN_SPREAD} THEN '*' ELSE shape[d + 1] END
  FROM (SELECT *, count(DISTINCT shape[d + 1]) OVER (PARTITION BY host, node) AS kinds, sum(n) OVER (PARTITION BY host, node) AS pages FROM g WHERE len(shape) > d)),
k AS (SELECT known.*, CASE WHEN node = '' THEN '/' ELSE node END AS template FROM known JOIN g ON g.host = known.host AND g.shape = known.shape AND g.d = len(known.shape)),
tt AS (SELECT host, template, list_filter(string_split(template, '/'), lambda x: x <> '') AS s, sum(labelled)::DOUBLE AS n, sum(bad)::DOUBLE AS b FROM k GROUP BY 1, 2),
t AS (SELECT * REPLACE (list_append(CASE WHEN len(s) > {LEVELS} THEN list_append(s[1:{LEVELS - 1}], array_to_string(s[{LEVELS}:], '/')) ELSE s END, '') AS s) FROM tt),
base AS (SELECT CASE WHEN sum(n) > 0 THEN sum(b) / sum(n) ELSE 0 END AS p FROM t),
st AS (SELECT host, template, n, b, i AS d, array_to_string(s[1:i], '/') AS node, s[i + 1] AS segment FROM t, generate_series(0, len(s) - 1) x(i)),
ch AS (SELECT host, d, node, segment, sum(n) AS n, sum(b) AS b FROM st GROUP BY ALL),
su AS (SELECT host, d, node, count(*) AS c, sum(n) AS pn, sum(b) AS pb, sum(1 / n) AS inverse, sum(b * b / n) AS squares FROM ch WHERE n > 0 GROUP BY ALL),
mm AS (SELECT *, pb / pn AS m, pb / pn * (1 - pb / pn) AS pq FROM su WHERE pb > 0 AND pb < pn),
ap AS (SELECT host, d, node, m FROM mm WHERE (squares - pn * m * m) / pq - (c - 1) > {SPREAD} * sqrt(greatest(c * 2 + inverse * (1 - pq * 6) / pq, 0))),
po AS (SELECT ch.host, ch.d, ch.segment, count(*) AS k, sum(ch.n) AS n, sum(ch.b) / sum(ch.n) AS s, sum(1 / ch.n) AS inverse, sum(ch.b * ch.b / ch.n) AS squares, sum(ch.b) - sum(ch.n * (pb / pn)) AS over_, sum(ch.n * (pb / pn) * (1 - pb / pn)) AS var_
  FROM ch JOIN su USING (host, d, node) WHERE ch.n > 0 GROUP BY ALL HAVING count(*) > 1),
al AS (SELECT host, d, segment, over_ > 0 AS more FROM po WHERE var_ > 0 AND abs(over_) > {SPREAD} * sqrt(var_)
  AND NOT CASE WHEN s > 0 AND s < 1 THEN (squares - n * s * s) / (s * (1 - s)) - (k - 1) > {SPREAD} * sqrt(greatest(k * 2 + inverse * (1 - s * (1 - s) * 6) / (s * (1 - s)), 0)) ELSE FALSE END),
so AS (SELECT ch.*, m, CASE WHEN m IS NULL OR n = 0 THEN '{NEAR}' WHEN b - n * m > {APART} * sqrt(n * m * (1 - m)) THEN '{ABOVE}' WHEN b - n * m < -{APART} * sqrt(n * m * (1 - m)) THEN '{BELOW}' ELSE '{NEAR}' END AS side, more
  FROM ch LEFT JOIN ap USING (host, d, node) LEFT JOIN al USING (host, d, segment)),
sd AS (SELECT *, more IS NOT NULL AND side <> CASE WHEN more THEN '{BELOW}' ELSE '{ABOVE}' END AS pooled FROM so),
pl AS (SELECT host, d, node, segment, pooled OR m IS NOT NULL AS split, CASE WHEN pooled THEN more ELSE side = '{ABOVE}' END AS above, sum(n) OVER w AS mn, sum(b) OVER w AS mb,
  CASE WHEN pooled THEN '/' || repeat('*/', d::INT) || segment ELSE CASE WHEN node = '' THEN '/' ELSE '/' || node || '/' END || CASE WHEN count(*) OVER w > 1 THEN side ELSE segment END END AS branch
  FROM sd WINDOW w AS (PARTITION BY host, d, pooled, CASE WHEN pooled THEN '' ELSE node END, CASE WHEN pooled THEN segment ELSE side END)),
f AS (SELECT host, template, -1 AS d, '/' AS branch, (sum(b) OVER h + p * {SMOOTHING}) / (sum(n) OVER h + {SMOOTHING}) AS share, sum(b) OVER h - sum(n) OVER h * p > {APART} * sqrt(sum(n) OVER h * p * (1 - p)) AS told FROM t, base WINDOW h AS (PARTITION BY host) UNION ALL
  SELECT f.host, f.template, st.d, CASE WHEN split THEN pl.branch ELSE f.branch END, CASE WHEN split THEN (mb + share * {SMOOTHING}) / (mn + {SMOOTHING}) ELSE share END, told OR (split AND above) FROM f JOIN st ON st.host = f.host AND st.template = f.template AND st.d = f.d + 1
  JOIN pl ON pl.host = st.host AND pl.d = st.d AND pl.node = st.node AND pl.segment = st.segment),
j AS (SELECT host, template, arg_max(branch, d) AS branch, arg_max(share, d) AS share, arg_max(told, d) AS told FROM f GROUP BY 1, 2)
SELECT page_id, r.host, path, CASE {" ".join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{h}{p}'" for h, p, _ in _BY_LENGTH)} END AS rule,
  CASE {" ".join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{v}'" for h, p, v in _BY_LENGTH)} WHEN told AND share >= {REJECT} THEN 'block' ELSE 'allow' END AS verdict, k.template, j.branch
FROM r JOIN k ON k.host = r.host AND k.shape = r.shape JOIN j ON j.host = k.host AND j.template = k.template
"""


def _damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations with faults by a hash of conversation and turn; nulls are one space."""
    filled = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    kept = rows.where(fault != 0).select("conv_id", "turn", F.when(fault == 4, "user").otherwise(filled("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return kept.drop("copy")


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    report = repair_report(repaired_pieces(_damaged(rows)))
    every = rows.select("conv_id").distinct()  # also those that lost all rows
    joined = every.join(report, every["conv_id"].eqNullSafe(report["conv"]), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query
def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii_spans(docs, fit_pii(docs), keep=["doc_id"])
    kinds = F.array(*map(F.lit, ALL))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k, kind: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["kind"] < len(PII_BASE))
    return found.select("doc_id", *[count(k, kind) for k, kind in enumerate(PII_BASE)], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


def _with_repetition(docs: DataFrame) -> DataFrame:
    """Every tenth document, by a hash of its id, goes round in a period from some word on."""
    h = F.crc32(docs["doc_id"].cast("string").cast("binary"))
    split = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all(text_of(docs), F.lit(WORD), F.lit(0))).alias("words"), F.floor(h / 10).alias("g")).withColumn("n", F.size("words"))
    placed = split.withColumn("a", F.when(F.col("n") > 0, F.expr("g % n").cast("int"))).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    unit = F.slice("words", F.col("a") + 1, F.col("p"))
    round_ = F.flatten(F.array_repeat(unit, F.expr("cast((n - a) div p as int)") + 1))
    words = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), round_), F.lit(1), F.col("n"))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_with_repetition(table(spark, sf_dir, "documents")), keep=["doc_id"])
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    found = found.select("*", longest.alias("longest")).select("*", (-F.col("longest.less")).alias("length"), F.col("longest.period").alias("period"))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("longest.start").alias("start"), "length", "period", F.expr("1000 * length div period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    )
