import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablemill.llm.periodic import _found, periodic_runs
from tests.llm.conftest import NASTY


def brute_runs(words):
    """By the definition: every period, every maximal stretch, and no smaller period in the stretch."""
    n, out = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(12, 2 * p) and not any(all(words[x] == words[x + q] for x in range(i, j + p - q)) for q in range(1, p)):
                out.append((i, j + p - i, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_kept(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^ \t-\r]+", text or "")


def plain(found):
    return [([(r["start"], r["length"], r["period"]) for r in runs], left) for runs, left in found]


piece = st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(1, 12)).map(lambda x: x[0] * x[1])
texts = st.lists(piece, max_size=6).map(lambda ps: " ".join(w for p in ps for w in p))


@given(st.lists(st.one_of(st.none(), texts), max_size=5))
@settings(max_examples=400, deadline=None)
def test_runs_against_the_definition(batch):
    want = [(r := brute_runs(words_of(t)), brute_kept(words_of(t), r)) for t in batch]
    assert plain(_found(batch)) == want


def test_runs_of_special_words():
    fibonacci = ["a", "b"]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    rng = random.Random(3)
    noise = [rng.choice("ab") for _ in range(300)]
    nested = ("a " * 20 + "b ") * 12 + "c " + ("a " * 20 + "b ") * 3
    for words in (list(fibonacci[-1]), noise, nested.split(), ["x"] * 700, ["x"] * 11, ["x"] * 12, list("abcdef") * 2, list("abcde") * 2):
        runs = brute_runs(words)
        assert plain(_found([" ".join(words)])) == [(runs, brute_kept(words, runs))]


def test_long_texts_are_fast():
    import time

    began = time.perf_counter()
    same, _ = _found(["w " * 400_000])[0]
    assert [tuple(r.values()) for r in same] == [(0, 400_000, 1)]
    rng = np.random.Generator(np.random.PCG64(1))
    half = [f"w{k}" for k in rng.zipf(1.3, 100_000)]
    runs, left = _found([" ".join(half * 2)])[0]
    assert {"start": 0, "length": 200_000, "period": 100_000} in runs
    assert time.perf_counter() - began < 30


def planted(doc_id, text):
    words = words_of(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_query_against_plain_search(spark, small):
    from tablemill.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op13_periodic_runs"](spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    seen = 0
    for r in rows:
        words = planted(r.doc_id, docs[r.doc_id])
        if len(words) > 700:  # the definition takes too long; runs of long texts have a test of their own
            continue
        runs = brute_runs(words)
        seen += len(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_kept(words, runs).encode()).hexdigest()
    assert seen > 20


def test_periodic_nasty(spark, nasty):
    rows = periodic_runs(nasty.withColumns({"runs": F.lit(1), "collapsed": F.lit(2)})).collect()
    assert len(rows) == len(NASTY) and rows[0].kept == 1
    by_id = {r.doc_id: r for r in rows if r.doc_id}
    assert [tuple(x) for x in by_id[6].runs] == [(0, 3000, 1)] and by_id[6].collapsed == "word"
    assert by_id[3].runs == [] and by_id[3].collapsed == "" and by_id[9].collapsed == ""
    assert periodic_runs(nasty.limit(0)).count() == 0
