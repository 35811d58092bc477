import json
import math
from collections import Counter

import duckdb
import pytest

from tablemill import queries
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, oracle, name):
    df = queries.QUERIES[name](spark, SMALL)
    want = oracle.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    places = [want.columns.index(c) for c in columns]
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    assert got == Counter(tuple(plain(r[k]) for k in places) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries()) and set(queries.QUERIES) <= set(e.queries())


def test_input_tokens_of_all_rows(spark):
    import __spark_entry__ as e

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()
    sizes = sorted(len("Sys\nRate: " + json.dumps({"text": r.text}, ensure_ascii=False, separators=(",", ":"))) for r in docs)
    assert len(sizes) > 100
    for got in (queries.QUERIES["token_estimate_input_all"](spark, SMALL).first(), e.entry(spark).first()):
        assert (got.sample_count, got.total_estimated, got.min, got.max) == (len(sizes), sum(sizes), sizes[0], sizes[-1])


def test_whole_texts_are_sent_to_the_model(spark, monkeypatch):
    sent, infer = [], queries.infer.infer
    monkeypatch.setattr(queries.infer, "infer", lambda rows, *a, **b: sent.append(rows) or infer(rows, *a, **b))
    queries.QUERIES["infer_documents"](spark, SMALL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r.doc_id: json.loads(r.prompt)["text"] for r in sent[0].collect()} == texts


def test_filter_reaches_the_scan(spark):
    plan = queries.QUERIES["volume_filter"](spark, SMALL)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan and "l_comment" not in plan


def test_tokens_by_vocabulary(spark):
    import public_tokenizers

    from tablemill.plans.tokens import _encoding

    library = _encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert set(queries.QUERIES) - set(queries.ORACLES) == {"token_estimate_by_vocabulary"}
    got = {r.side: r for r in queries.QUERIES["token_estimate_by_vocabulary"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    said = lambda r: queries.TEMPLATE.replace("{record_json}", json.dumps({"text": r.text}, ensure_ascii=False, separators=(",", ":")))
    sizes = sorted(len(library.encode_ordinary(said(r))) for r in docs)
    assert (got["input"].sample_count, got["input"].total_estimated, got["input"].min, got["input"].max) == (len(sizes), sum(sizes), sizes[0], sizes[-1])
    assert got["output"].sample_count == spark.read.parquet(f"{SMALL}/labels.parquet").count() and got["output"].min > 5
