import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablemill.llm import exact_dedup, ngram_join, substring_dedup
from tablemill.llm.components import components
from tests.llm.conftest import NASTY


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup_against_brute_force(spark, keep):
    rng = random.Random(2)
    rows = [(i, rng.choice(["Hot copy", "hot COPY", "ÄB", "äb", "", None, f"own {i}", "x" * 60 + str(i % 5)])) for i in range(400)]
    rng.shuffle(rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), keep=keep).collect()}
    assert len(got) == 400
    for i, t in rows:
        own = groups[lowered(t)]
        best = (max if keep == "max" else min)(own)
        assert tuple(got[i]) == (i, best, len(own), i == best, hashlib.sha256(lowered(t).encode()).hexdigest())


def test_exact_dedup_nasty(nasty):
    rows = exact_dedup.exact_dedup(nasty).collect()
    assert len(rows) == len(NASTY)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert sum(r.kept for r in by_id[8]) == 1 and {r.group_size for r in by_id[8]} == {2}
    assert by_id[1][0].keep_id == 2 and by_id[1][0].group_size == 3  # with the null id
    assert by_id[3][0].keep_id == 5 and by_id[3][0].group_size == 4  # null and empty texts
    assert exact_dedup.exact_dedup(nasty.limit(0)).count() == 0
    kept = exact_dedup.drop_copies(nasty)
    assert kept.columns == nasty.columns and {r.doc_id for r in kept.collect()} == {2, 5, 6, 7, 8, 9}  # the rows without an id have copies with one


def test_native_plan(spark, small):
    from tablemill.llm.queries import QUERIES

    plan = QUERIES["op2_exact_dedup"](spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_classes(docs, threshold=0.8):
    """Class and number of links of each document by comparing word tuples of all pairs."""
    sets = {}
    for i, t in docs:
        w = ngram_join._WORDS(lowered(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids, top, links = sorted(sets), {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) >= threshold * max(len(sets[a]), len(sets[b])):
                common = len(sets[a] & sets[b])
                if common / (len(sets[a]) + len(sets[b]) - common) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    p, q = find(a), find(b)
                    top[max(p, q)] = min(p, q)
    return {i: (find(i), links[i]) for i in ids}


def near_corpus(n=260, seed=3):
    rng = random.Random(seed)
    words = ["w%d" % k for k in range(500)]
    bases = [[rng.choice(words) for _ in range(rng.choice([4, 30, 120, 400]))] for _ in range(30)]
    docs = []
    for i in range(n):
        base = list(bases[0] if i % 3 == 0 else rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            base[rng.randrange(len(base))] = rng.choice(words)
        docs.append((i, " ".join(base)))
    return docs


def test_ngram_join_against_brute_force(spark):
    docs = near_corpus()
    want = brute_classes(docs)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == want


def test_ngram_join_over_blocks(spark, monkeypatch):
    docs = near_corpus(120, seed=9)
    monkeypatch.setattr(ngram_join, "TILE_SETS", 8)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == brute_classes(docs)


def quotes(words, first_id):
    """Short documents, one for each band, that quote the phrases whose hashes are the band's minima in a text of ``words``: strangers at the head of all its buckets."""
    phrases = [" ".join(words[k : k + 5]) for k in range(len(words) - 4)]
    hashes = np.concatenate([ngram_join.shingles(p) for p in phrases])
    least = ((hashes[:, None] * ngram_join._FACTORS) >> np.uint64(32)).argmin(axis=0).reshape(ngram_join.BANDS, ngram_join.ROWS)
    return [(first_id + b, " ".join(phrases[k] for k in row)) for b, row in enumerate(least)]


def long_pair(rng, n=3000):
    a = [f"w{rng.randrange(10**9)}" for _ in range(n)]
    b = list(a)
    for at in (n // 4, n // 2, 3 * n // 4):
        b[at] = f"w{rng.randrange(10**9)}"
    return a, b


def test_strangers_at_the_head_of_buckets_cost_no_links(spark):
    rng = random.Random(21)
    docs = []
    for k in range(12):
        a, b = long_pair(rng, 600)
        docs += quotes(a, 100 * k) + [(100 * k + 50, " ".join(a)), (100 * k + 51, " ".join(b))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == brute_classes(docs) and got[50] == (50, 1)


def test_ngram_join_over_cut_buckets(spark, monkeypatch):
    docs = near_corpus(200, seed=13)
    monkeypatch.setattr(ngram_join, "SIG_BLOCK", 6)
    monkeypatch.setattr(ngram_join, "TILE_SETS", 16)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == brute_classes(docs)


def test_spanning_connects_what_pairs_connect():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 16, (6, 128), dtype=np.uint16)
    sigs = base[rng.integers(0, 6, 80)].copy()
    turned = rng.random(sigs.shape) < rng.random((80, 1)) * 0.3
    sigs[turned] = rng.integers(0, 1 << 16, int(turned.sum()), dtype=np.uint16)
    sizes = rng.choice([90, 100, 200], 80)
    forest = ngram_join.spanning(sigs, sizes, 0.8)

    def roots(pairs):
        top = list(range(80))
        for a, b in pairs * 80:
            top[a] = top[b] = min(top[a], top[b])
        return top

    may = [(a, b) for a in range(80) for b in range(a + 1, 80) if min(sizes[a], sizes[b]) >= 0.8 * max(sizes[a], sizes[b]) and ngram_join.may_reach(sigs[a : a + 1], sigs[b : b + 1], 0.8)[0]]
    assert roots(forest) == roots(may) and len(forest) == 80 - len(set(roots(may)))


def test_ngram_join_on_documents(spark, small):
    from tablemill.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in QUERIES["op5_ngram_join"](spark, small).collect()}
    assert got == brute_classes(docs)


def test_ngram_join_nasty(nasty):
    rows = ngram_join.ngram_join(nasty).collect()
    assert len(rows) == len(NASTY)
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[2].class_id == 1 and by_id[1].n_links == 2 and by_id[3].n_links == 0 and by_id[3].class_id == 3
    assert by_id[8].class_id == 8 and by_id[8].n_links == 1
    assert ngram_join.ngram_join(nasty.limit(0)).count() == 0


def test_rows_that_repeat_an_id(spark):
    text = lambda *w: " ".join([f"w{k}" for k in range(100)] + list(w))
    rows = [(1, text("a")), (1, text("a")), (2, text("b")), (3, text("c")), (3, "something else that nobody has anywhere at all"), (4, text("a"))]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    # each row is a document; the other text of 3 is alone
    assert got == [(1, 1, 4), (1, 1, 4), (2, 1, 4), (3, 1, 4), (3, 3, 0), (4, 1, 4)]


def brute_rows(rows):
    """(class_id, n_links) of each row, ids repeated or null."""
    found = brute_classes(list(enumerate(t for _, t in rows)))
    least = {}
    for k, (i, _) in enumerate(rows):
        c = found[k][0]
        least[c] = i if least.get(c) is None else least[c] if i is None else min(i, least[c])
    return [(i, least[found[k][0]] if words(t) else i, found[k][1]) for k, (i, t) in enumerate(rows)]


def words(text):
    return re.findall(r"[^ \t-\r]+", text or "")


def twisted_rows():
    text = lambda *w: " ".join([f"w{k}" for k in range(100)] + list(w))
    rows = [(1, text("a")), (1, text("b")), (2, text("c")), (None, text("d")), (None, text("d")), (None, "alone it is"), (None, "alone it is"), (9, "only one"), (5, None), (5, ""), (None, None)]
    rng = random.Random(4)
    return rows + [(rng.choice([None, 20, 21, 22, 23, i]), t) for i, t in near_corpus(60, seed=2)]


def test_repeated_and_null_ids_against_brute_force_and_sql(spark):
    import duckdb

    from tablemill.llm.queries import ORACLES

    rows = twisted_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(df).collect())
    assert got == Counter(brute_rows(rows))
    assert got[(1, 1, 4)] == 2 and got[(None, 1, 4)] == 2 and got[(None, None, 1)] >= 2
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == Counter(con.sql(f"SELECT doc_id, class_id, n_links FROM ({ORACLES['op5_ngram_join']})").fetchall())


def test_one_row_of_a_class_stays(spark):
    rows = twisted_rows()
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, _place int")
    kept = ngram_join.drop_near_copies(df).collect()
    found = brute_classes(list(enumerate(t for _, t in rows)))
    classes = {}
    for k, (i, t) in enumerate(rows):
        classes.setdefault(found[k][0] if words(t) else -k - 1, []).append(i)
    best = [min((i is None, i or 0) for i in ids) for ids in classes.values()]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(best) and kept[0].__fields__ == df.columns
    assert ngram_join.drop_near_copies(df.limit(0)).count() == 0


def test_one_row_of_equal_texts_stays(spark):
    rows = [(1, "a"), (1, "a"), (None, "b"), (None, "B"), (3, "b"), (4, None), (4, ""), (None, "c"), (None, "c"), (7, "x"), (7, "y")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id bigint, text string, _stays int")
    kept = exact_dedup.drop_copies(df, keep="max").collect()
    assert Counter((r.doc_id, (r.text or "").lower()) for r in kept) == Counter([(1, "a"), (3, "b"), (4, ""), (None, "c"), (7, "x"), (7, "y")])
    assert kept[0].__fields__ == df.columns and exact_dedup.drop_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("keep", ["max", "min"])
def test_rows_move_once_whatever_the_number_of_copies(spark, keep):
    """Verdicts stay with the rows: no join of whole rows, whose shuffle would come with the number of copies."""
    rng = random.Random(3)
    rows = [(i if rng.random() < 0.9 else None, rng.choice(["Hot copy", "hot COPY", "ÄB", "äb", "", None, f"Own {i % 150}", "x" * 60 + str(i % 5)])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    ids = {t: [i for i in own if i is not None] for t, own in groups.items()}
    want = Counter((t, (max if keep == "max" else min)(own) if own else None) for t, own in ids.items())
    kept = exact_dedup.drop_copies(df, keep=keep)
    assert Counter((lowered(r.text), r.doc_id) for r in kept.collect()) == want
    unlike = spark.createDataFrame([(i, f"Own {i // 2}") for i in range(2000)], "doc_id bigint, text string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for some in (df, unlike):
            plan = exact_dedup.drop_copies(some, keep=keep)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and plan.count("rangepartitioning") == 1 and "hashpartitioning(_row" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert exact_dedup.drop_copies(unlike, keep=keep).count() == 1000


def test_pruning_keeps_what_may_reach():
    least = ngram_join.least_matches(0.8, 1e-6)
    assert least == sorted(least) and least[0] < 0.8 * 32 and least[-1] < 0.8 * 128
    a = np.zeros((2, 128), dtype=np.uint32)
    b = np.zeros((2, 128), dtype=np.uint32)
    b[1, :100] = 1
    assert ngram_join.may_reach(a, b, 0.8).tolist() == [True, False]


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(200, k) for k in range(201, 260)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    top = {}
    for u, v in edges:
        top.setdefault(u, u), top.setdefault(v, v)
    for _ in range(len(top)):
        for u, v in edges:
            top[u] = top[v] = min(top[u], top[v])
    assert got == {k: v for k, v in top.items()}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_chunks_cover_and_resist_insertions():
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefgé漢") for _ in range(rng.randrange(2, 9))) for _ in range(3000))
    data = text.encode()
    ends = substring_dedup.chunk_ends(data)
    assert ends[-1] == len(data) and all(b > a for a, b in zip(ends, ends[1:], strict=False))
    pieces = [data[a:b].decode() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    assert "".join(pieces) == text
    other = ("inserted words " + text[:5000] + " more of them " + text[5000:]).encode()
    moved = substring_dedup.chunk_ends(other)
    again = {other[a:b] for a, b in zip([0, *moved[:-1]], moved, strict=True)}
    assert sum(p.encode() in again for p in pieces) > 0.97 * len(pieces)
    assert substring_dedup.chunk_ends(b"").tolist() == []
    same = substring_dedup.chunk_ends(b"a" * 5000)
    assert max(np.diff([0, *same])) <= substring_dedup.MAX_CHUNK + 4


def planted(seed=8):
    """Documents of their own words, some with a passage of 55 to 80 words that others have too."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8)))
    own = lambda n: [word() for _ in range(n)]
    passages = [own(rng.randrange(55, 80)) for _ in range(10)]
    docs, has = [], {}
    for i in range(150):
        body = own(200)
        if i % 3 == 0:
            p = rng.randrange(len(passages))
            at = rng.randrange(len(body))
            body[at:at] = passages[p]
            has[i] = p
        docs.append((i, " ".join(body)))
    return docs, has


def test_repeats_are_found_and_clean_documents_left(spark):
    docs, has = planted()
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    every = substring_dedup.repeated_spans(df).collect()
    spans = [r for r in every if not r.kept]
    first = {}
    for i in sorted(has):
        first.setdefault(has[i], i)
    want = {i for i in has if first[has[i]] != i}
    assert {r.doc_id for r in spans} == want
    assert {r.doc_id for r in every} >= want | {first[has[i]] for i in want}
    text = dict(docs)
    for r in spans:  # where two documents go on alike after the passage by chance, the earlier of them is the holder of that end
        assert has[r.first_id] == has[r.doc_id] and text[r.doc_id][r.start : r.stop] in text[r.first_id]
    assert sum(r.first_id == first[has[r.doc_id]] for r in spans) >= 0.9 * len(want)
    cut = {r.doc_id: r.text for r in substring_dedup.cut_spans(df, substring_dedup.repeated_spans(df)).collect()}
    for i in text:
        gone = sum(r.stop - r.start for r in spans if r.doc_id == i)
        assert len(cut[i]) == len(text[i]) - gone


def repeated_windows(docs, width):
    """For each document, the starts of windows of ``width`` characters that come earlier, by id and start, found by plain search. Windows of one unit again and again, which have no place to cut at, aren't counted."""
    seen, out = set(), defaultdict(list)
    for i, t in sorted(docs):
        for k in range(len(t) - width + 1):
            w = t[k : k + width]
            if w in seen and len({w[j : j + 16] for j in range(width - 16)}) > width // 2:
                out[i].append(k)
            seen.add(w)
    return out


def test_repeats_against_plain_search(spark, small):
    from tablemill.llm.queries import QUERIES

    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    text, rows = dict(docs), QUERIES["op8_substring_dedup"](spark, small).collect()
    repeats = [r for r in rows if not r.kept]
    # all that is said to repeat does: it stands at its first place, which is an earlier one
    for r in repeats:
        assert (r.first_id, r.first_start) < (r.doc_id, r.start)
        assert text[r.doc_id][r.start : r.stop] == text[r.first_id][r.first_start : r.first_start + r.stop - r.start]
    covered = defaultdict(set)
    for r in repeats:
        covered[r.doc_id].update(range(r.start, r.stop))
    # characters of windows that come again are covered, and every repeat's first place is in a kept row
    for width, least in ((100, 0.93), (200, 0.97), (400, 0.99)):
        there = {i: {p for k in starts for p in range(k, k + width)} for i, starts in repeated_windows(docs, width).items()}
        assert sum(len(p & covered[i]) for i, p in there.items()) >= least * sum(map(len, there.values())), width
    kept = {(r.doc_id, p) for r in rows if r.kept for p in range(r.start, r.stop)}
    assert all({(r.first_id, r.first_start), (r.first_id, r.first_start + r.stop - r.start - 1)} <= kept for r in repeats)
    # repeats of a document don't overlap
    by_id = defaultdict(list)
    for r in repeats:
        by_id[r.doc_id].append((r.start, r.stop))
    assert all(a[1] <= b[0] for spans in by_id.values() for a, b in zip(sorted(spans), sorted(spans)[1:], strict=False))
    for spans in by_id.values():  # those without a gap between them are long enough together
        stretches = []
        for a, b in sorted(spans):
            if stretches and stretches[-1][1] == a:
                stretches[-1][1] = b
            else:
                stretches.append([a, b])
        assert all(b - a >= substring_dedup.MIN_RUN for a, b in stretches)


def test_every_chunk_that_comes_again_is_reported(spark):
    """A text whose chunks have each another holder: all of it but what lies outside of whole chunks is repeated."""
    rng = random.Random(31)
    own = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    text = own(4000)
    ends = [0, *substring_dedup.chunk_ends(text.encode()).tolist()]
    docs = [(k, own(200) + text[max(0, a - 40) : b + 40] + own(200)) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False))] + [(1000, text)]
    rows = [r for r in substring_dedup.repeated_spans(spark.createDataFrame(docs, "doc_id bigint, text string")).collect() if not r.kept and r.doc_id == 1000]
    places = [p for r in rows for p in range(r.start, r.stop)]
    assert len(set(places)) == len(places) >= 0.9 * len(text) and len({r.first_id for r in rows}) > 30
    by_id = dict(docs)
    assert all(by_id[r.first_id][r.first_start : r.first_start + r.stop - r.start] == text[r.start : r.stop] for r in rows)


def test_repeats_end_where_texts_differ(spark):
    rng = random.Random(33)
    own = lambda n, of="abcdefghijklmnop ": "".join(rng.choice(of) for _ in range(n))
    docs, want = [(0, own(300))], []
    passage = own(320, "abcdefghijklmnop é漢")
    for k in range(1, 40):
        docs.append((k, f"{own(rng.randrange(0, 200))}{k % 10}{passage}{chr(0x391 + k)}{own(100)}"))
        at = docs[-1][1].index(passage)
        want.append((k, at, at + len(passage)))
    rows = [r for r in substring_dedup.repeated_spans(spark.createDataFrame(docs, "doc_id bigint, text string")).collect() if not r.kept]
    exact = {(r.doc_id, r.start, r.stop) for r in rows} & set(want)
    # what comes before the passage may be alike by chance
    assert len(exact) >= 30 and {r.doc_id for r in rows} == set(range(2, 40))


def test_units_again_and_again(spark):
    docs = [(1, "the same words again, " * 40), (2, "x" * 3000), (3, "ab" * 500 + "c")]
    rows = [r for r in substring_dedup.repeated_spans(spark.createDataFrame(docs, "doc_id bigint, text string")).collect() if not r.kept]
    for i, t in docs:
        assert sum(r.stop - r.start for r in rows if r.doc_id == i) >= 0.85 * len(t)


def test_every_passage_of_a_cut_document_stays_somewhere(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    cut = {r.doc_id: r.text or "" for r in substring_dedup.cut_spans(docs, substring_dedup.repeated_spans(docs)).collect()}
    assert set(cut) == set(text) and sum(map(len, cut.values())) < sum(map(len, text.values()))
    earlier = {}
    for r in substring_dedup.repeated_spans(docs).where("not kept").collect():
        earlier |= {(r.doc_id, p): (r.first_id, r.first_start + p - r.start) for p in range(r.start, r.stop)}
    for i, t in text.items():
        assert cut[i] == "".join(c for p, c in enumerate(t) if (i, p) not in earlier)
    # whatever was cut leads, from place to earlier place, to one that stays
    for at, to in earlier.items():
        while to in earlier:
            assert earlier[to] < to
            to = earlier[to]
        assert text[at[0]][at[1]] == text[to[0]][to[1]]


def test_repeats_nasty(nasty):
    rows = substring_dedup.repeated_spans(nasty).collect()
    # 6 and 7 repeat themselves; 1 and 2 share less than a repeat has to have; the rows of 8 are one document
    assert {(r.doc_id, r.first_id) for r in rows} == {(6, 6), (7, 7)}
    assert substring_dedup.repeated_spans(nasty.limit(0)).count() == 0
    assert substring_dedup.cut_spans(nasty, substring_dedup.repeated_spans(nasty)).count() == len(NASTY)


def test_a_passage_follows_one_holder(spark):
    """Two neighbouring passages that come first in different documents are two repeats, each of its own holder."""
    rng = random.Random(11)
    own = lambda n: "".join(rng.choice("abcdefghijklmnop \u00e9\u6f22") for _ in range(n))
    one, two = own(600), own(700)
    docs = [(1, own(300) + one + own(90)), (2, own(150) + two + own(400)), (3, own(200) + one + two + own(200))]
    rows = [r for r in substring_dedup.repeated_spans(spark.createDataFrame(docs, "doc_id bigint, text string")).collect() if not r.kept]
    text = dict(docs)
    assert {(r.doc_id, r.first_id) for r in rows} == {(3, 1), (3, 2)}
    assert all(text[3][r.start : r.stop] in text[r.first_id] for r in rows)


def test_repetition_inside_a_document_is_found(spark):
    rng = random.Random(12)
    own = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = own(400)
    text = f"{own(50)}<{passage}>{own(90)}({passage})[{passage}]"
    df = spark.createDataFrame([(1, text), (2, own(900))], "doc_id bigint, text string")
    rows = sorted(tuple(r) for r in substring_dedup.repeated_spans(df).collect() if not r.kept)
    assert len(rows) == 2 and all(r[3] == 1 and 51 <= r[4] < 451 for r in rows)
    assert [text.count("(", 0, r[1]) + text.count("[", 0, r[1]) for r in rows] == [1, 2]


def test_long_texts_are_chunked_in_slices(monkeypatch):
    """Ends don't depend on where the slices of a long text are."""
    rng = random.Random(14)
    data = bytes(rng.randrange(97, 110) for _ in range((1 << 18) + 5000))
    ends = substring_dedup.chunk_ends(data)
    tail = substring_dedup.chunk_ends(data[(1 << 18) - 2000 :]) + (1 << 18) - 2000
    assert set(ends[ends > (1 << 18) - 1500]) == set(tail[tail > (1 << 18) - 1500])
