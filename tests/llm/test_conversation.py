import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablemill.llm import conversation
from tablemill.llm.conversation import repair_report, repaired_pieces, repaired_turns

WHITE = " \t\n\v\f\r"


def shown(role):
    return role[:1]


def brute(rows):
    """(figures, audit, repaired) of rows (turn, role, text) in order: every edit at every row, letters compared as strings."""
    seen, faults = set(), []
    for _, role, text in rows:
        said = text.strip(WHITE)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(maxsize=None)
    def best(i, tail, room):
        """(cost, letters, turns) from row i on; tail is the initials so far, kept to what matters; room bounds inserts in a row."""
        out = []
        if i == len(rows):
            if tail in ("", "a"):
                out.append((0, "", ()))
        else:
            extra = 5 * (faults[i] == "truncated")
            c, s, t = best(i + 1, tail, 2)
            out.append((2 + c, "D" + s, t))
            if faults[i] not in ("blank", "duplicate"):
                for letter, role, price in (("K", rows[i][1], 0), ("R", "user", 1), ("R", "assistant", 1)):
                    after = step(tail, shown(role))
                    if after is not None:
                        c, s, t = best(i + 1, after, 2)
                        out.append((price + extra + c, letter + s, ((role, rows[i][2]), *t)))
        if room:
            for role in ("user", "assistant"):
                after = step(tail, role[0])
                if after is not None:
                    c, s, t = best(i, after, room - 1)
                    out.append((5 + c, "I" + s, ((role, ""), *t)))
        return min(out) if out else (10**9, "", ())

    def step(tail, initial):
        if initial == "s":
            return "s" if tail == "" else None
        if initial == "u":
            return "u" if tail in ("", "s", "a") else None
        return "a" if initial == "a" and tail == "u" else None

    cost, audit, turns = best(0, "", 2)
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [shown(r) for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    lines = "\n".join(f"{r}:{t}" for r, t in turns)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()), turns


role = st.sampled_from(["system", "user", "assistant", "user", "assistant", "tool", "", "User"])
text = st.sampled_from(["Yes.", "No!", "cut", " ", "", "a?\n", "Yes.", "é"])
conversations = st.lists(st.tuples(role, text), max_size=9)


@given(st.lists(conversations, min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_edits_against_all_edits(many):
    groups = [(k, [(n, *r) for n, r in enumerate(rows)]) for k, rows in enumerate(many) if rows]
    for (_, rows), got in zip(groups, conversation._solved(groups), strict=True):
        (*_, cost, audit, _), turns = brute(rows)
        assert (got[-3], got[-2], [(t["role"], t["text"]) for t in got[-1]]) == (cost, audit, list(turns))
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in got[-1]))


def test_costs_between_the_ends_of_blocks():
    rng = np.random.Generator(np.random.PCG64(5))
    codes = rng.integers(0, 12, (40, 7))
    whole = conversation.backward(codes, np.repeat(conversation.END[None], 7, axis=0))
    cut = conversation.backward(codes[:25], whole[25])
    assert (cut == whole[:26]).all()


def made_rows(n, seed, ids):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut", "", "Why?", " ", "Then go."] + [f"Words {k}." for k in range(40)]
    rows = [(rng.choice(ids), rng.choice([None, *range(30)]), rng.choice([None, "system", "user", "assistant", "user", "assistant", "tool"]), rng.choice([None, *texts])) for _ in range(n)]
    return rows + rows[: n // 10]


def ordered(rows):
    out = {}
    for conv, turn, who, said in rows:
        out.setdefault(conv, []).append((turn, " " if who is None else who, " " if said is None else said))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def report_of(df, **how):
    rows = repair_report(repaired_pieces(df, **how)).collect()
    return {r.conv: tuple(r)[1:] for r in rows}, len(rows)


def test_long_conversations_give_the_same(spark):
    rows = made_rows(700, 9, [1, 2, 3, None]) + [(7, 3, "user", "Again.")] * 150
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = {c: brute(r)[0] for c, r in ordered(rows).items()}
    assert report_of(df) == (want, 5)
    # with no lower limit, those of over a quarter of a partition's share are cut into blocks of a few rows
    pieces = repaired_pieces(df, long_rows=0, block_rows=7)
    assert pieces.where("not whole").count() > 50
    assert report_of(df, long_rows=0, block_rows=7) == (want, 5)
    turns = [tuple(r) for r in repaired_turns(pieces).where("conv = 2").orderBy("place", "position").select("role", "text").collect()]
    assert turns == list(brute(ordered(rows)[2])[1])


def damaged(rows):
    out = {}
    for conv, turn, who, said in rows:
        who, said = who or " ", " " if said is None else said
        here = out.setdefault(conv, [])
        fault = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        said = "" if fault == 1 else re.sub("[.!?]", "", said) if fault == 2 else said
        here += [(turn, "user" if fault == 4 else who, said)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return {c: sorted(r, key=lambda x: x[0]) for c, r in out.items()}


def test_query_against_all_edits(spark, small):
    from tablemill.llm.queries import QUERIES

    path = small.replace("0.001", "0.01")
    given_rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: brute(r)[0] for c, r in damaged(given_rows).items()}
    rows = QUERIES["op11_conversation_repair"](spark, path).collect()
    assert rows[0].__fields__ == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r)[1:] for r in rows} == want and len(rows) == len(want)
    assert sum(r.cost for r in rows) > 0


def test_conversations_nasty(spark, tmp_path):
    from tablemill.llm.queries import QUERIES

    schema = "conv_id bigint, turn bigint, role string, text string, conv int, place int, cost int, _long int"
    rows = [(None, None, None, None), (1, None, "user", "x" * 300_000 + "."), (1, None, "user", "x" * 300_000 + "."), (1, 5, "assistant", "Ünïcode 漢字!"), (2, 1, "", ""), (None, 3, "user", "Hm.")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], schema)
    want = {c: brute(r)[0] for c, r in ordered(rows).items()}
    for how in ({}, {"long_rows": 0, "block_rows": 2}):
        assert report_of(df, **how) == (want, 3)
        assert report_of(df.limit(0), **how) == ({}, 0)
    # a conversation whose rows are all dropped has a row of zeros
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df.where("conv_id = 2").unionByName(spark.createDataFrame([(gone, 0, "user", "Hm.", 0, 0, 0, 0)], schema)).write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and len(found) == 2
    assert repaired_turns(repaired_pieces(df.select("*", F.lit(1).alias("whole")))).count() == sum(len(brute(r)[1]) for r in ordered(rows).values())
