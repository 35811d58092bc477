"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text; a chunk ends where the hash is the least of the places around it. Ends depend
on the bytes near them alone, so an insertion moves them but changes only the chunks that it touches. Chunks are compared
by 96-bit digests. The first place of a chunk, by id and start, keeps it; each later place, in the same document or in
another, repeats it. Neighbouring repeats are one passage as long as their first places are neighbours as well, so a
passage stands in its first holder just as it stands in the repeat. Chunks are seeds: a passage goes on into the chunks at its ends
as far as these are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.common import fresh, small_batches, staged, text_of

#: The hash is over so many bytes (a power of two).
GEAR_BYTES = 16
#: A chunk ends where the hash is the least of so many places to either side: chunks have over REACH bytes, twice that on average.
REACH = 32
#: Where no place stands out for so many bytes, as in a run of one character, a chunk ends at the least hash among them.
MAX_CHUNK = 256
#: A stretch of repeats has at least so many characters.
MIN_RUN = 72
_GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunk_ends(data: bytes) -> np.ndarray:
    """Ends of the chunks of UTF-8 ``data`` in bytes, each before the first byte of a character."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    out, start = [], 0
    for end in [*_least_places(raw), n]:
        while end - start > MAX_CHUNK:
            # the first place of the least hash: in a text of one unit again and again, always the same one of the unit
            reach = raw[start + REACH - GEAR_BYTES : start + MAX_CHUNK]
            start = _whole(raw, start + REACH + int(_hashes(reach)[GEAR_BYTES - 1 :].argmin()))
            out.append(start)
        end = _whole(raw, end)
        if end > start:
            out.append(end)
            start = end
    return np.array(out, dtype=np.int64)


def _whole(raw: np.ndarray, at: int) -> int:
    """The first place from ``at`` on that isn't inside a character."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def _hashes(raw: np.ndarray) -> np.ndarray:
    """The hash after each byte; the first ones are over fewer than GEAR_BYTES."""
    h, span = _GEAR[raw], 1
    while span < GEAR_BYTES:
        shifted = h[:-span] << np.uint32(span)
        h = h.copy()
        h[span:] += shifted
        span *= 2
    return h


def _least_places(raw: np.ndarray) -> list[int]:
    """Places after which a chunk ends: the hash there is below all of REACH before and not above any of REACH after."""
    n, out = len(raw), []
    if n <= 2 * REACH:
        return out
    # in slices, so that memory follows the text and not what is reckoned about it; each sees all that decides its places
    width = 1 << 18
    for lo in range(0, n, width):
        a, b = max(0, lo - REACH - GEAR_BYTES), min(n, lo + width + REACH)
        h = _hashes(raw[a:b])
        # minima of REACH places, by doubling
        least, width_ = h, 1
        while width_ < REACH:
            least = np.minimum(least[:-width_], least[width_:])
            width_ *= 2
        p = np.arange(max(lo, REACH), min(lo + width, n - REACH)) - a
        out += (p[(h[p] < least[p - REACH]) & (h[p] <= least[p + 1])] + a + 1).tolist()
    return out


def chunks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per chunk: id, start and stop in characters, digest (high, low)."""
    schema = pa.schema([("_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("high", pa.int64()), ("low", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        ids: list[np.ndarray] = []
        spans: list[np.ndarray] = []
        digests: list[bytes] = []

        def made() -> pa.RecordBatch:
            whole = np.frombuffer(b"".join(digests), dtype=np.dtype([("high", "<i8"), ("low", "<i4"), ("rest", "<i4")]))
            places = np.concatenate(spans)
            cols = [np.concatenate(ids), places[:, 0].astype(np.int32), places[:, 1].astype(np.int32), np.ascontiguousarray(whole["high"]), np.ascontiguousarray(whole["low"])]
            for x in (ids, spans, digests):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                data = text.encode()
                ends = chunk_ends(data)
                if not len(ends):
                    continue
                first = np.concatenate(([0], ends[:-1]))
                digests += [digest(data[a:b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                if len(text) < len(data):  # bytes that begin a character, counted up to each end
                    begins = np.frombuffer(data, dtype=np.uint8) & 0xC0 != 0x80
                    ends = np.cumsum(np.add.reduceat(begins, first, dtype=np.int64))
                    first = np.concatenate(([0], ends[:-1]))
                ids.append(np.full(len(ends), doc.as_py(), dtype=np.int64))
                spans.append(np.stack([first, ends], axis=1))
                if len(digests) > 1 << 15:
                    yield made()
        if digests:
            yield made()

    small_batches(df.sparkSession)
    rows = df.select(df[id_col].cast("bigint").alias("_id"), text_of(df, text_col).alias("_text")).where("_id is not null")
    return rows.mapInArrow(run, "_id bigint, start int, stop int, high bigint, low int")


def _surroundings(df: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, start, stop, before, after) for the different ``spans`` (doc, start, stop): up to MAX_CHUNK characters on either side.

    A document's spans are sent to its text as one list, which is no longer than the document has chunks. Where rows that repeat an id
    would give different surroundings, there are none.
    """
    wanted = spans.groupBy("doc").agg(F.collect_set(F.struct("start", "stop")).alias("_spans"))
    rows = df.select(df[id_col].cast("bigint").alias("_id"), text_of(df, text_col).alias("_text")).join(wanted, F.col("_id") == F.col("doc")).select("_id", "_text", "_spans")
    schema = pa.schema([("doc", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("before", pa.string()), ("after", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                places = batch.column(2)[k].values
                starts, stops = places.field("start").to_pylist(), places.field("stop").to_pylist()
                for lo in range(0, len(starts), 4096):
                    some = list(zip(starts[lo : lo + 4096], stops[lo : lo + 4096], strict=True))
                    cols = [[doc] * len(some), [x[0] for x in some], [x[1] for x in some], [text[max(0, x - MAX_CHUNK) : x] for x, _ in some], [text[y : y + MAX_CHUNK] for _, y in some]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    small_batches(df.sparkSession)
    found = rows.mapInArrow(run, "doc bigint, start int, stop int, before string, after string")
    said = F.struct("before", "after")
    return found.groupBy("doc", "start", "stop").agg(F.min(said).alias("_one"), F.max(said).alias("_other")).where("_one = _other").select("doc", "start", "stop", "_one.before", "_one.after")


def _common(a: str | None, b: str | None) -> int:
    """How many characters two texts have in common at their beginning."""
    if not a or not b:
        return 0
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


def _extended(runs: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Runs (_id, start, stop, first_id, first_start) carried on, to the left and right, as far as the text around them is that around their first place."""
    first_stop = F.col("first_start") + F.col("stop") - F.col("start")
    here = runs.select(F.col("_id").alias("doc"), "start", "stop")
    there = runs.select(F.col("first_id").alias("doc"), F.col("first_start").alias("start"), first_stop.alias("stop"))
    around = staged(_surroundings(df, here.unionByName(there), id_col, text_col), "surroundings")
    named = lambda tag: around.select(*[F.col(c).alias(f"_{tag}_{c}") for c in around.columns])
    own, holder = named("own"), named("first")
    rows = runs.join(own, (F.col("_id") == own["_own_doc"]) & (F.col("start") == own["_own_start"]) & (F.col("stop") == own["_own_stop"]), "left")
    # the holder's side has a row per place, so Spark can split the runs of a passage that very many documents share
    rows = rows.join(holder, (F.col("first_id") == holder["_first_doc"]) & (F.col("first_start") == holder["_first_start"]) & (first_stop == holder["_first_stop"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [_common(a and a[::-1], b and b[::-1]) for a, b in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True)]
            right = [_common(a, b) for a, b in zip(batch.column(7).to_pylist(), batch.column(8).to_pylist(), strict=True)]
            start, stop, first = (np.asarray(batch.column(k)) for k in (1, 2, 4))
            moved = [batch.column(0), pa.array(start - np.array(left, np.int32)), pa.array(stop + np.array(right, np.int32)), batch.column(3), pa.array(first - np.array(left, np.int32))]
            yield pa.RecordBatch.from_arrays(moved, names=["_id", "start", "stop", "first_id", "first_start"])

    rows = rows.select("_id", "start", "stop", "first_id", "first_start", "_own_before", "_first_before", "_own_after", "_first_after")
    return rows.mapInArrow(run, "_id bigint, start int, stop int, first_id bigint, first_start int")


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """One row per passage that comes again: the id, start, stop, first_id, first_start, kept.

    Rows with ``kept`` false are repeats: text[start:stop] is also at first_start of the document first_id, which is
    another one of smaller id or an earlier place of the same. Every chunk that comes again is in one, and so is what is alike
    beside it up to the first character that differs. Repeats that follow each other without a gap, whoever their holders are,
    are left out only if together they are shorter than ``min_run`` characters; they don't overlap. Rows with ``kept`` true are the first
    places, brought together where they overlap. Places count characters, stop exclusive.

    Null ids are left out: nothing could refer to them. Null and empty texts have no chunks. Rows that repeat an id count
    as one document, whose places are those of all of them. Texts are chunked once, and those with repeats are read once more for what is
    around these. Digests are counted before the shuffle; a passage that very many documents share is a hot key of joins alone,
    where one side has a row per key, so that Spark can split the other.
    """
    each = staged(chunks(df, id_col, text_col), "chunks")
    place = F.struct("_id", "start")
    shared = each.groupBy("high", "low").agg(F.min(place).alias("_least"), F.max(place).alias("_most")).where("_least < _most").select(F.bitwise_not("high").alias("_high"), F.col("low").alias("_low"), "_least")
    held = each.join(shared, (F.bitwise_not("high") == F.col("_high")) & (F.col("low") == F.col("_low"))).where(place > F.col("_least"))
    # one shuffle by document serves the duplicates of a repeated id and the windows
    held = held.select("_id", "start", "stop", F.col("_least._id").alias("first_id"), F.col("_least.start").alias("first_start")).repartition("_id").dropDuplicates(["_id", "start", "stop"])
    order = Window.partitionBy("_id").orderBy("start", "stop")
    before = lambda c: F.lag(c).over(order)
    goes_on = (before("stop") == F.col("start")) & (before("first_id") == F.col("first_id")) & (before("first_start") + before("stop") - before("start") == F.col("first_start"))
    runs = held.withColumn("_run", F.sum(F.when(goes_on, 0).otherwise(1)).over(order)).groupBy("_id", "_run")
    runs = staged(runs.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("first_id").alias("first_id"), F.min("first_start").alias("first_start")).drop("_run"), "runs")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    spans = _extended(runs, df, id_col, text_col)
    # what a repeat has in common with the one before it is that one's
    covered = F.greatest(F.coalesce(F.max("stop").over(past), F.lit(0)) - F.col("start"), F.lit(0))
    apart = spans.withColumn("_less", covered).select("_id", (F.col("start") + F.col("_less")).alias("start"), "stop", "first_id", (F.col("first_start") + F.col("_less")).alias("first_start")).where("start < stop")
    gap = F.coalesce(F.lag("stop").over(order) < F.col("start"), F.lit(True)).cast("int")
    of_stretch = Window.partitionBy("_id", "_stretch")
    stretches = apart.withColumn("_gap", gap).withColumn("_stretch", F.sum("_gap").over(order)).withColumn("_length", F.sum(F.col("stop") - F.col("start")).over(of_stretch))
    repeats = staged(stretches.where(F.col("_length") >= min_run).select("_id", "start", "stop", "first_id", "first_start"), "repeats")
    firsts = repeats.select(F.col("first_id").alias("_id"), F.col("first_start").alias("start"), (F.col("first_start") + F.col("stop") - F.col("start")).alias("stop")).distinct()
    islands = firsts.withColumn("_run", F.sum(F.when(F.col("start") > F.max("stop").over(past), 1).otherwise(0)).over(order)).groupBy("_id", "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    kept = islands.select("_id", "start", "stop", F.col("_id").alias("first_id"), F.col("start").alias("first_start"), F.lit(True).alias("kept"))
    return repeats.withColumn("kept", F.lit(False)).unionByName(kept).withColumnRenamed("_id", id_col).select(id_col, "start", "stop", "first_id", "first_start", "kept")


def cut_spans(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the repeats among the spans cut out of its texts; documents without repeats are unchanged."""
    key, cuts = fresh(df, "_key", "_cuts")
    by_doc = spans.where(~F.col("kept")).groupBy(F.col(id_col).alias(key)).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(cuts))
    joined = df.join(by_doc, df[id_col].cast("bigint") == by_doc[key], "left")
    text = text_of(df, text_col)
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(cuts, F.greatest(i, F.lit(1)))["stop"])
    end = lambda i: F.when(i == F.size(cuts), F.length(text)).otherwise(F.element_at(cuts, F.least(i + 1, F.size(cuts)))["start"])
    left = F.array_join(F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda i: F.substring(text, begin(i) + 1, end(i) - begin(i))), "")
    return joined.select(*[F.when(F.col(cuts).isNull(), F.col(f"`{c}`")).otherwise(left).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])
