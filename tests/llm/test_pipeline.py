import sys
from array import array
from collections import Counter
from pathlib import Path

import public_tokenizers
import tiktoken

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline

from tablemill.llm.bpe import load_ranks
from tests.llm.test_dedup import brute_classes, lowered
from tests.llm.test_filters import brute_measure
from tests.llm.test_outputs import plain_targets


def test_stages_against_brute_force(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    frames = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        frames.append(docs)
        if k < 4:
            assert docs.columns == columns

    good = lambda t: (m := brute_measure(t))[0] >= 20 and 100 * m[4] <= 30 * m[0]
    kept = {i: r for i, r in kept.items() if good(r.text)}
    assert {r.doc_id for r in frames[0].collect()} == set(kept)

    best = {}
    for i, r in kept.items():
        best[lowered(r.text)] = max(best.get(lowered(r.text), i), i)
    kept = {i: kept[i] for i in best.values()}
    assert sorted(r.doc_id for r in frames[1].collect()) == sorted(kept)

    classes = brute_classes([(i, r.text) for i, r in kept.items()])
    kept = {i: r for i, r in kept.items() if classes[i][0] == i}
    assert sorted(r.doc_id for r in frames[2].collect()) == sorted(kept)

    sizes, taken = Counter(), Counter()
    for r in kept.values():
        sizes[r.source] += brute_measure(r.text)[0]
    mixed = frames[3].collect()
    for r in mixed:
        taken[r.source] += brute_measure(r.text)[0]
    assert all(abs(taken[s] - t) <= 1 for s, t in plain_targets(sizes, [3, 1, 2], 1.5, 2).items())

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = Counter((r.doc_id, tuple(library.encode_ordinary(r.text))) for r in mixed)
    rows = frames[4].collect()
    assert Counter((r.doc_id, tuple(array("I", bytes(r.ids)))) for r in rows) == want and all(r.round_trip for r in rows)


def test_run_gives_the_last_stage(spark, small):
    assert corpus_pipeline.run(spark, small).columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]


def test_a_task_of_the_last_stage_needs_one_python_worker(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = corpus_pipeline.encoded(spark, docs, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_stages_on_nasty_rows(spark, nasty, small):
    from pyspark.sql import functions as F

    for docs in (nasty, nasty.limit(0)):
        docs = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), "source", F.length("text").cast("bigint").alias("n_chars"), *[c for c in docs.columns if c not in ("doc_id", "text", "source")])
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, small)
            rows = docs.collect()
            assert k == 4 or "text" in docs.columns, name
        assert all(r.round_trip for r in rows)
