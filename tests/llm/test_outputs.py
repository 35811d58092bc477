import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablemill.llm import mixing, token_files
from tests.llm.conftest import NASTY


@given(st.lists(st.integers(0, (1 << 32) - 1) | st.integers(0, 3) | st.just(0) | st.integers(0, 70000), max_size=700), st.sampled_from([1, 7, 64, 4096]))
@settings(max_examples=300, deadline=None)
def test_words_round_trip(ids, block):
    words, offsets = token_files.pack(np.array(ids, dtype=np.uint32), block)
    assert token_files.unpack(words).tolist() == ids
    for k, at in enumerate(offsets):  # any block can be decoded alone
        end = offsets[k + 1] if k + 1 < len(offsets) else len(words)
        assert token_files.unpack(words[at:end]).tolist() == ids[k * block : (k + 1) * block]


def test_token_files_query(spark, small):
    from tablemill.llm.queries import QUERIES

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    got = {r.doc_id: r for r in QUERIES["op6_token_files"](spark, small).collect()}
    start = 0
    for i, t in docs:
        ids = array("I", [*library.encode(t, add_special_tokens=False).ids, 2])
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_any_span_of_ids_is_read_by_its_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "RECORD_IDS", 10_000)
    rng = np.random.default_rng(3)
    docs = [(i, "".join(map(chr, rng.integers(32, 50_000, int(rng.integers(0, 3000)))))) for i in range(40)]
    token_files.write_token_files(spark.createDataFrame(docs, "doc_id bigint, text string"), f"{tmp_path}/a", lambda: lambda texts: [array("I", map(ord, t)).tobytes() for t in texts], 2, partitions=3)
    every = np.concatenate([np.array([*map(ord, t), 2]) for _, t in docs])
    for start, n in ((0, 1), (0, len(every)), (5000, 9000), (4095, 2), (12_288, 4096), (len(every) - 7, 100), (len(every), 5), (17, 0)):
        rows = sorted(token_files.read_ids(spark, f"{tmp_path}/a", start, n).collect())
        got = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(r.ids, dtype="<u4") for r in rows)])
        assert got.tolist() == every[start : start + n].tolist() and all(a.start + len(a.ids) // 4 == b.start for a, b in zip(rows, rows[1:], strict=False))
        assert not rows or rows[0].start == start


def test_ids_that_words_cannot_hold_are_refused():
    with pytest.raises(ValueError):
        token_files.pack(np.array([1, 1 << 60], dtype=np.uint64))
    assert token_files.unpack(token_files.pack(np.array([(1 << 60) - 1], dtype=np.uint64))[0]).tolist() == [(1 << 60) - 1]


def test_token_files_nasty(spark, nasty, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "RECORD_IDS", 40)
    make = lambda: lambda texts: [array("I", map(ord, t)).tobytes() for t in texts]
    token_files.write_token_files(nasty, f"{tmp_path}/a", make, 2)
    rows = sorted(token_files.read_token_files(spark, f"{tmp_path}/a").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, *_ in NASTY), key=lambda i: (i is not None, i))
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    texts = Counter("".join(map(chr, array("I", bytes(r.ids))[:-1])) for r in rows)
    assert texts == Counter(t or "" for _, t, _ in NASTY)
    token_files.write_token_files(nasty.limit(0), f"{tmp_path}/b", make, 2)
    assert token_files.read_token_files(spark, f"{tmp_path}/b").count() == 0


def plain_targets(sizes, weights, share, cap):
    """Water-filling as it is told: clamp what is above its cap, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] >= cap * sizes[s]]
        if not over:
            return {s: fixed.get(s, level * w[s]) for s in names}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mixing_query(spark, small):
    from tablemill.llm.queries import QUERIES

    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op7_mixing"](spark, small).collect()
    again = QUERIES["op7_mixing"](spark, small).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == len(docs)
    size = {i: len(__import__("re").findall(r"[^ \t-\r]+", r.text or "")) for i, r in docs.items()}
    sizes = Counter()
    for i, r in docs.items():
        sizes[r.source] += size[i]
    want, taken = plain_targets(sizes, [3, 1, 2], 1.5, 2), Counter()
    for r in rows:
        source = docs[r.doc_id].source
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[source]) and 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(want[source]) and r.taken == r.epochs * r.size + r.part
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


@given(st.dictionaries(st.sampled_from(["a", "b", "c", "d", "é", "漢", None]), st.integers(0, 1000), min_size=1), st.sampled_from([0.5, 1.5, 1.99]))
@settings(max_examples=15, deadline=None)
def test_targets_against_plain_filling(spark, sizes, share):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(df, [3, 1, 2], share, 2).collect()}
    assert got == pytest.approx(plain_targets(sizes, [3, 1, 2], share, 2))


def test_mixing_nasty(spark, nasty):
    mixed = mixing.mix(nasty)
    rows = mixed.collect()
    assert len(rows) == len(NASTY) and all(r.taken == 0 for r in rows if r.doc_id in (3, 4, 5, 9))
    by_target = defaultdict(lambda: [0, 0.0])
    for r in rows:
        if r.source_size:
            by_target[r.source_size, r.target][0] += r.taken
    assert all(abs(taken - target) <= 1 for (_, target), (taken, _) in by_target.items())
    assert mixing.mix(nasty.limit(0)).count() == 0
    # repeated ids and null ones are drawn like any others, with all columns
    extra = nasty.withColumns({"_row": F.lit("r"), "_key": F.lit(1)})
    drawn = mixing.draw(extra)
    assert drawn.columns == extra.columns
    words, taken = Counter(), Counter()
    for r in drawn.collect():
        words[r.doc_id] += len((r.text or "").split())
        assert (r._row, r._key) == ("r", 1)
    for r in rows:
        taken[r.doc_id] += r.taken
    assert words == Counter({i: n for i, n in taken.items() if n}) and words[None] > 0
    assert mixing.draw(nasty.limit(0)).count() == 0
