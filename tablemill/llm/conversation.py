"""Repair of the structure of conversations: the cheapest edits that make the roles ``(s?(ua)+)?``.

What was emitted so far is one of four states: nothing, a system turn, a user's turn last, an assistant's turn last. The
least cost from each state to the end is found turn by turn from the last to the first, and the edits are read off from the
first to the last, both as NumPy steps over all conversations of a batch: conversations are bucketed by length and laid
out turn by turn (time-major) with their ends aligned.

A conversation goes to one task, unless it has so many rows that it would be much of a partition. Such a one is sorted over
many tasks and cut into blocks. A block's costs between its ends are a 4 x 4 matrix; these are chained from the last block to
the first, which gives the costs that each block needs, then the blocks are traced from all four states, and the states
are chained from the first block to the last. Only these few numbers of a block go through one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import small_batches, staged

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Conversations of more rows, and of more than a quarter of a partition's share, are cut into blocks of BLOCK_ROWS rows or about BLOCK_BYTES.
LONG_ROWS, BLOCK_ROWS, BLOCK_BYTES = 20_000, 2048, 4 << 20
#: Conversations are solved together up to so many rows or bytes.
_SOLVE_ROWS, _SOLVE_BYTES = 1 << 14, 8 << 20

_NONE = 1 << 40
_USER, _ASSISTANT = 2, 3  # the states after such turns; 0: nothing yet, 1: a system turn
_NEXT = np.array([_USER, _USER, _ASSISTANT, _USER])  # the state after a turn that may follow
_PAD = 12
_LEGAL = {"su", "ua", "au"}
_WHITE = " \t\n\v\f\r"


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code (4 * fault + kind of role, or _PAD) and state: the cost and next state of Keep, and the cost of Rerole."""
    keep, to, rerole = np.full((13, 4), _NONE), np.zeros((13, 4), np.int64), np.full((13, 4), _NONE)
    for fault in range(2):  # 0: none, 1: truncated; faults of 2 must be deleted
        for kind in range(4):  # 0: s, 1: u, 2: a, 3: any other
            for state in range(4):
                rerole[4 * fault + kind, state] = REROLE + TRUNCATED * fault
                if (kind == 0 and state == 0) or (kind == 1 and state != _USER) or (kind == 2 and state == _USER):
                    keep[4 * fault + kind, state], to[4 * fault + kind, state] = TRUNCATED * fault, kind + 1
    keep[_PAD], to[_PAD] = 0, np.arange(4)
    return keep, to, rerole


_KEEP, _KEEP_TO, _REROLE = _tables()
_DELETE = np.where(np.arange(13) == _PAD, _NONE, DELETE)


def _with_inserts(cost: np.ndarray) -> np.ndarray:
    """Costs by state where turns may be inserted first."""
    out = cost.copy()
    out[:, _USER] = np.minimum(cost[:, _USER], INSERT + cost[:, _ASSISTANT])
    out[:, _ASSISTANT] = np.minimum(cost[:, _ASSISTANT], INSERT + cost[:, _USER])
    out[:, :_USER] = np.minimum(cost[:, :_USER], INSERT + out[:, _USER : _USER + 1])
    return out


def backward(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least costs to the end [turn, conversation, state] for codes [turn, conversation], from the costs at the end."""
    cost = np.empty((len(codes) + 1, *end.shape), dtype=np.int64)
    cost[-1] = end
    rows = np.arange(codes.shape[1])[:, None]
    for t in range(len(codes) - 1, -1, -1):
        code, after = codes[t], cost[t + 1]
        least = np.minimum(_DELETE[code][:, None] + after, _KEEP[code] + after[rows, _KEEP_TO[code]])
        least = np.minimum(least, _REROLE[code] + after[:, _NEXT])
        cost[t] = np.where((code == _PAD)[:, None], after, _with_inserts(np.minimum(least, _NONE)))
    return cost


END = _with_inserts(np.array([[0, _NONE, _NONE, 0]]))[0]


def trace(codes: np.ndarray, cost: np.ndarray, state: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """The ASCII-least of the cheapest edits from these states: letters [conversation, place], 0 where there is none, and the states reached."""
    steps, many = codes.shape
    rows, state = np.arange(many), state.copy()
    letters = np.zeros((many, 3 * steps + 2), dtype=np.uint8)

    def insert(t: int, place: int, allowed: np.ndarray | bool) -> None:
        here = cost[t]
        put = (INSERT + here[rows, _NEXT[state]] == here[rows, state]) & allowed
        letters[put, place] = ord("I")
        state[put] = _NEXT[state[put]]

    for t in range(steps):
        code, here, after = codes[t], cost[t], cost[t + 1]
        for k in range(2):
            insert(t, 3 * t + k, (code != _PAD) & (_DELETE[code] + after[rows, state] != here[rows, state]))
        left = here[rows, state]
        delete = (_DELETE[code] + after[rows, state] == left) & (code != _PAD)
        keep = ~delete & (_KEEP[code, state] + after[rows, _KEEP_TO[code, state]] == left) & (code != _PAD)
        rerole = ~delete & ~keep & (code != _PAD)
        for chosen, letter in ((delete, "D"), (keep, "K"), (rerole, "R")):
            letters[chosen, 3 * t + 2] = ord(letter)
        state = np.where(keep, _KEEP_TO[code, state], np.where(rerole, _NEXT[state], state))
    if last:
        for k in range(2):
            insert(steps, 3 * steps + k, True)
    return letters, state


def _buckets(codes: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Sequences of like length: which, and their codes by turn, ends aligned."""
    order = sorted(range(len(codes)), key=lambda k: len(codes[k]))
    for _, some in groupby(order, key=lambda k: len(codes[k]).bit_length()):
        some = list(some)
        laid = np.full((len(codes[some[-1]]), len(some)), _PAD, dtype=np.int64)
        for column, k in enumerate(some):
            if len(codes[k]):
                laid[-len(codes[k]) :, column] = codes[k]
        yield some, laid


def edits(codes: list[np.ndarray]) -> list[str]:
    """The edits of whole conversations."""
    out = [""] * len(codes)
    for some, laid in _buckets(codes):
        cost = backward(laid, np.repeat(END[None], len(some), axis=0))
        letters, _ = trace(laid, cost, np.zeros(len(some), dtype=np.int64), last=True)
        for k, row in zip(some, letters, strict=True):
            out[k] = row[row > 0].tobytes().decode()
    return out


def _coded(rows: list[tuple], repeated: Callable[[tuple], bool]) -> tuple[np.ndarray, list[int]]:
    """Codes of rows (turn, role, text, ...), and the number of blank, duplicate and truncated ones by their first fault."""
    codes, faults = np.empty(len(rows), dtype=np.int64), [0, 0, 0]
    for k, row in enumerate(rows):
        said, again = row[2].strip(_WHITE), repeated(row)
        fault = 0 if not said else 1 if again else 2 if said[-1] not in ".!?" else None
        if fault is not None:
            faults[fault] += 1
        codes[k] = 4 * (0 if fault is None else 1 if fault == 2 else 2) + "sua".find(row[1][:1] or "?") % 4
    return codes, faults


def _applied(rows: list[tuple], codes: np.ndarray, letters: str, state: int = 0) -> tuple[list[dict], int]:
    """The repaired turns, and what the edits cost."""
    out, cost, k = [], 0, 0
    for letter in letters:
        if letter == "D":
            cost, k = cost + DELETE, k + 1
            continue
        turn = {"role": "assistant" if state == _USER else "user", "text": ""}
        if letter == "I":
            cost += INSERT
        else:
            turn["text"] = rows[k][2]
            cost += TRUNCATED * int(codes[k] // 4 == 1) + REROLE * (letter == "R")
            if letter == "K":
                turn["role"] = rows[k][1]
        state = int(_KEEP_TO[codes[k], state] if letter == "K" else _NEXT[state])
        k += letter != "I"
        out.append(turn)
    return out, cost


#: What is known of a piece besides its edits; counts are of what lies within it.
_FIGURES = ["first_turn", "last_turn", "least_turn", "most_turn", "turns", "blank", "duplicate", "truncated", "illegal"]
_PIECE = [*((c, pa.int64()) for c in _FIGURES), ("first_role", pa.string()), ("last_role", pa.string())]
_PIECE_DDL = ", ".join(f"{c} {'bigint' if t == pa.int64() else 'string'}" for c, t in _PIECE)
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_EDITED = [("cost", pa.int64()), ("audit", pa.string()), ("repaired", _TURNS)]
_EDITED_DDL = "cost bigint, audit string, repaired array<struct<role:string,text:string>>"


def _figures(rows: list[tuple], faults: list[int]) -> list:
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))
    return [rows[0][0], rows[-1][0], min(turns, default=None), max(turns, default=None), len(set(turns)), *faults, illegal, initials[0], initials[-1]]


def _record(rows: list[list], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _solved(groups: list[tuple[object, list[tuple]]]) -> Iterator[list]:
    coded = []
    for _, rows in groups:
        seen: set[tuple] = set()
        coded.append(_coded(rows, lambda r: r[1:3] in seen or seen.add(r[1:3]) is not None))
    for (conv, rows), (codes, faults), letters in zip(groups, coded, edits([c for c, _ in coded]), strict=True):
        turns, cost = _applied(rows, codes, letters)
        yield [conv, 0, *_figures(rows, faults), cost, letters, turns]


def _whole(rows: DataFrame, n: int) -> DataFrame:
    """Pieces of conversations that go to one task each: one piece for a conversation."""
    kind = rows.schema["conv"].dataType.simpleString()
    names = ["conv", "place", *(c for c, _ in (*_PIECE, *_EDITED))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[tuple[object, list[tuple]]] = []
        rows_, size, conv_type = 0, 0, None

        def made() -> pa.RecordBatch:
            return _record(list(_solved(groups)), names, [conv_type, pa.int64(), *(t for _, t in (*_PIECE, *_EDITED))])

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not groups or groups[-1][0] != conv:
                    if rows_ > _SOLVE_ROWS or size > _SOLVE_BYTES:
                        yield made()
                        groups, rows_, size = [], 0, 0
                    groups.append((conv, []))
                groups[-1][1].append(tuple(row))
                rows_, size = rows_ + 1, size + len(row[2])
        if groups:
            yield made()

    laid = rows.repartition(n, "conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    return laid.select("conv", "turn", "role", "text").mapInArrow(run, f"conv {kind}, place bigint, {_PIECE_DDL}, {_EDITED_DDL}")


def _cut(rows: DataFrame, n: int, block_rows: int) -> DataFrame:
    """Blocks of long conversations in order of (conv, place), each with its rows, figures, codes and costs between its ends."""
    kind = rows.schema["conv"].dataType.simpleString()
    text = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    # equal rows are one row that counts, so that no key has many
    rows = rows.groupBy("conv", "turn", "role", "text").count().withColumn("_said", text)
    said = rows.groupBy("conv", "_said").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("conv").alias("_conv"), F.col("_said").alias("_same"), F.col("_first.turn").alias("_first"), F.lit(True).alias("_known"))
    rows = rows.join(said, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("_said") == F.col("_same")), "left")
    again = F.col("_known") & F.col("turn").isNotNull() & (F.col("_first").isNull() | (F.col("turn") > F.col("_first")))
    order = ["conv", F.col("turn").asc_nulls_first(), "role"]
    # ranges are cut by the beginning of a text, so that no whole texts are sampled
    cut = rows.select("conv", "turn", "role", "text", F.substring("text", 1, 64).alias("_begin"), "count", F.coalesce(again, F.lit(False)).alias("again")).repartitionByRange(n, *order, "_begin")
    laid = cut.sortWithinPartitions(*order, "text")
    names = ["conv", "place", *(c for c, _ in _PIECE), "codes", "rows", "between"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, conv, block, size = TaskContext.get().partitionId() << 32, None, [], 0

        def made() -> pa.RecordBatch:
            codes, faults = _coded(block, lambda r: r[3])
            ends = np.where(np.eye(4, dtype=bool), 0, _NONE)
            between = np.minimum(backward(np.repeat(codes[:, None], 4, axis=1), ends)[0].T, _NONE)  # [from, to]
            turns = [{"role": r, "text": "" if gone else x} for (_, r, x, _), gone in zip(block, (codes // 4 == 2).tolist(), strict=True)]
            kinds = [conv_type, pa.int64(), *(t for _, t in _PIECE), pa.binary(), _TURNS, pa.list_(pa.int64())]
            return _record([[conv, place, *_figures(block, faults), codes.astype(np.uint8).tobytes(), turns, between.ravel().tolist()]], names, kinds)

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for c, turn, role, text, copies, again in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                for k in range(copies):
                    if block and (c != conv or len(block) >= block_rows or size >= BLOCK_BYTES):
                        yield made()
                        place, block, size = place + 1, [], 0
                    conv = c
                    block.append((turn, role, text, again or k > 0))
                    size += len(text)
        if block:
            yield made()

    ddl = f"conv {kind}, place bigint, {_PIECE_DDL}, codes binary, rows array<struct<role:string,text:string>>, between array<bigint>"
    return staged(laid.select("conv", "turn", "role", "text", "count", "again").mapInArrow(run, ddl), "conversation-blocks")


def _chained(blocks: DataFrame, value: str, ddl: str, down: bool, start: list[int], step: Callable[[list[int], list[int]], list[int]], n: int) -> DataFrame:
    """(conv, place, state) with what the blocks before (or after) give, from ``start`` on, by ``step(state, value)``; one state is kept at a time."""
    kind = blocks.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = (), start
        for batch in batches:
            out = []
            for conv, given in zip(batch.column("conv").to_pylist(), batch.column(value).to_pylist(), strict=True):
                if now != (conv,):
                    now, state = (conv,), start
                out.append(state)
                state = step(state, given)
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("place"), pa.array(out, pa.list_(pa.int64()))], names=["_conv", "_place", "state"])

    laid = blocks.select("conv", "place", value).repartition(n, "conv").sortWithinPartitions("conv", F.col("place").desc() if down else F.col("place"))
    return laid.mapInArrow(run, f"_conv {kind}, _place bigint, state {ddl}")


def _joined(blocks: DataFrame, chained: DataFrame) -> DataFrame:
    return blocks.join(chained, blocks["place"].eqNullSafe(chained["_place"]) & blocks["conv"].eqNullSafe(chained["_conv"])).drop("_conv", "_place")


def _long(rows: DataFrame, n: int, block_rows: int) -> DataFrame:
    """Pieces of long conversations: one for each block."""
    blocks = _cut(rows, n, block_rows)
    kind = blocks.schema["conv"].dataType.simpleString()
    lead = lambda given, end: np.minimum((np.array(given).reshape(4, 4) + np.array(end)).min(axis=1), _NONE).tolist()
    ends = _chained(blocks, "between", "array<bigint>", True, END.tolist(), lambda state, given: lead(given, state), n)
    most = blocks.groupBy(F.col("conv").alias("_last_conv")).agg(F.max("place").alias("_last"))
    known = _joined(blocks, ends).join(most, F.col("conv").eqNullSafe(F.col("_last_conv"))).select(*blocks.columns, "state", (F.col("place") == F.col("_last")).alias("last"))

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, to = [], []
            for codes, end, last in zip(*(batch.column(c).to_pylist() for c in ("codes", "state", "last")), strict=True):
                laid = np.repeat(np.frombuffer(codes, dtype=np.uint8).astype(np.int64)[:, None], 4, axis=1)
                cost = backward(laid, np.repeat(np.array([end]), 4, axis=0))
                got, reached = trace(laid, cost, np.arange(4), last)
                letters.append([r[r > 0].tobytes().decode() for r in got])
                to.append(reached.tolist())
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("place"), pa.array(letters, pa.list_(pa.string())), pa.array(to, pa.list_(pa.int64()))], names=["conv", "place", "letters", "to"])

    paths = staged(known.select("conv", "place", "codes", "state", "last").mapInArrow(traced, f"conv {kind}, place bigint, letters array<string>, to array<bigint>"), "conversation-paths")
    starts = _joined(paths.select("conv", "place", "letters"), _chained(paths, "to", "array<bigint>", False, [0], lambda state, to: [to[state[0]]], n))
    chosen = starts.select(F.col("conv").alias("_conv"), F.col("place").alias("_place"), F.col("state")[0].alias("from"), F.element_at("letters", (F.col("state")[0] + 1).cast("int")).alias("audit"))
    names = ["conv", "place", *(c for c, _ in (*_PIECE, *_EDITED))]

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, turns = [], []
            for codes, given, state, letters in zip(*(batch.column(c).to_pylist() for c in ("codes", "rows", "from", "audit")), strict=True):
                got, cost = _applied([(None, x["role"], x["text"]) for x in given], np.frombuffer(codes, dtype=np.uint8), letters, state)
                costs.append(cost)
                turns.append(got)
            kept = [batch.column(c) for c in names[: 2 + len(_PIECE)]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(costs, pa.int64()), batch.column("audit"), pa.array(turns, _TURNS)], names=names)

    return _joined(blocks, chosen).drop("between").mapInArrow(done, f"conv {kind}, place bigint, {_PIECE_DDL}, {_EDITED_DDL}")


def repaired_pieces(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", long_rows: int = LONG_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Repaired conversations in pieces (conv, place, whole, ..., cost, audit, repaired); a piece is a conversation, or a block of a long one.

    Rows of a conversation are taken by turn, null turns first, equal turns by role and text. A row's first fault counts:
    blank, duplicate (role and text seen earlier), truncated (its last character that isn't white space isn't one of
    ``.!?``). Edits: K keeps, R sets the role to user or assistant (1), D deletes (2, required for blank and duplicate rows), I inserts an
    empty turn (5); a truncated row that stays adds 5. ``audit`` has the letters of the cheapest edits, of equal ones
    the least in ASCII; ``repaired`` the turns. A role counts by its first character; an empty one fits nowhere.

    Null roles and texts are one space. Rows with a null id are one conversation. An empty table gives no pieces; other columns aren't read.
    A conversation of more than ``long_rows`` rows and a quarter of a partition's share goes through blocks, with the same result.
    """
    spark = df.sparkSession
    small_batches(spark)
    filled = lambda c: F.coalesce(df[c].cast("string"), F.lit(" "))
    rows = df.select(df[conv_col].alias("conv"), df[turn_col].cast("bigint").alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy("conv").count()
    said = counts.agg(F.sum("count").alias("total"), F.max("count").alias("most")).first()
    limit = max(long_rows, (said.total or 0) // (4 * n))
    if (said.most or 0) <= limit:
        return _whole(rows, n).withColumn("whole", F.lit(True))
    # at most 4n conversations are longer than that
    long = F.broadcast(staged(counts.where(F.col("count") > limit).select(F.col("conv").alias("_long")), "long-conversations"))
    same = rows["conv"].eqNullSafe(long["_long"])
    parts = _whole(rows.join(long, same, "left_anti"), n).withColumn("whole", F.lit(True))
    return parts.unionByName(_long(rows.join(long, same, "left_semi"), n, block_rows).withColumn("whole", F.lit(False)))


def repaired_turns(pieces: DataFrame) -> DataFrame:
    """A row per repaired turn: conv, place of the piece, position in it, role, text."""
    return pieces.select("conv", "place", F.posexplode("repaired").alias("position", "_turn")).select("conv", "place", "position", "_turn.role", "_turn.text")


def repair_report(pieces: DataFrame) -> DataFrame:
    """A row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of its ``role:text`` lines.

    The digest of a long conversation is made in the order of its pieces, one at a time: its memory is that of a piece and of the edits' letters.
    """
    figures = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    line = lambda t: F.concat(t["role"], F.lit(":"), t["text"])
    lines = F.array_join(F.transform("repaired", line), "\n")
    gaps: Column = F.when(F.col("turns") > 0, F.col("most_turn") - F.col("least_turn") + 1 - F.col("turns")).otherwise(F.lit(0)).cast("bigint")
    one = pieces.where("whole").select("conv", gaps.alias("gaps"), *figures, F.sha2(lines, 256).alias("repaired_sha256"))
    kind = pieces.schema["conv"].dataType.simpleString()
    rest = pieces.where("not whole").withColumn("_lines", lines).withColumn("_some", F.size("repaired") > 0).drop("repaired", "whole")
    names = ["conv", "gaps", *figures, "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, letters, digest, before = None, {}, [], None, None

        def made() -> pa.RecordBatch:
            gaps = sums["most"] - sums["least"] + 1 - sums["turns"] if sums["turns"] else 0
            row = [now[0], gaps, *(sums[c] for c in figures[:-1]), "".join(letters), digest.hexdigest()]
            return _record([row], names, [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()])

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                if now != (r["conv"],):
                    if now:
                        yield made()
                    now, letters, digest, before, started = (r["conv"],), [], hashlib.sha256(), None, False
                    sums = dict.fromkeys([*figures[:-1], "turns"], 0) | {"least": None, "most": None}
                for c in (*figures[:-1], "turns"):
                    sums[c] += r[c]
                if before:
                    sums["illegal"] += before["last_role"] + r["first_role"] not in _LEGAL
                    sums["turns"] -= before["last_turn"] is not None and before["last_turn"] == r["first_turn"]
                if r["turns"]:  # pieces follow each other by turn
                    sums["least"], sums["most"] = r["least_turn"] if sums["least"] is None else sums["least"], r["most_turn"]
                letters.append(r["audit"])
                if r["_some"]:
                    digest.update((("\n" if started else "") + r["_lines"]).encode())
                    started = True
                before = r
        if now:
            yield made()

    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rest.repartition(n, "conv").sortWithinPartitions("conv", "place")
    return one.unionByName(laid.mapInArrow(run, f"conv {kind}, gaps bigint, {', '.join(f'{c} bigint' for c in figures[:-1])}, audit string, repaired_sha256 string"))
