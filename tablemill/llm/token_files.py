"""Token files: ids in Simple-8b words, written in order of the documents' ids and read back without a scan of what is before.

A file is Parquet, which any store that Spark knows can hold and whose commit survives lost executors. A record holds
consecutive documents: their ids, their lengths, the coded ids of all of them, and the place of each block's first word.
A word has a selector in its top four bits, and the selector says how many ids of how many bits follow. An id of
over 30 bits escapes into a word of its own. Blocks end on word limits, so any of them can be decoded alone, and
decoding takes all words with the same selector at once.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablemill.llm.common import small_batches

#: Fixed values of the word-aligned code: (ids in a word, bits of each), by selector; the last is the escape.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_COUNTS = np.array([n for n, _ in SELECTORS], dtype=np.int64)
BLOCK = 4096
RECORD_IDS = 1 << 16
#: Documents encoded at a time; an Arrow batch is bounded in bytes, too.
SLICE = 1024
SCHEMA = "part int, seq int, before bigint, n_ids bigint, doc_ids array<bigint>, lengths array<int>, offsets array<int>, words binary"


def _in_a_row(fits: np.ndarray, count: int) -> np.ndarray:
    """Where ``count`` places in a row, the last of which exists, are all true."""
    width = 1
    while width < count:
        step = min(width, count - width)
        fits = fits[:-step] & fits[step:]
        width += step
    return fits


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words of ``ids`` (under 2**60), and where each block of ``block`` ids begins among them."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    top = int(ids.max())
    if top >> 60:
        raise ValueError(f"ids are under 2**60, not {top}")
    small = ids.astype(np.uint32) if top < 1 << 32 else ids.astype(np.uint64)
    ids = ids.astype(np.uint64)
    at = np.arange(n, dtype=np.int32)
    left = np.minimum(block - at % block, n - at)
    choice = np.full(n, len(SELECTORS) - 1, dtype=np.int8)
    for s in range(len(SELECTORS) - 2, -1, -1):
        count, bits = SELECTORS[s]
        if count > n:
            break
        ok = left[: n - count + 1] >= count
        if top >> bits:
            ok &= _in_a_row(small < 1 << bits, count)
            if not ok.any():
                break  # fewer bits fit nowhere either
        # what fits here has fitted all selectors before, which hold fewer and wider ids
        choice[: n - count + 1] -= ok.view(np.int8)
    # by each place, where the word after it and the fourth word after it begin
    after = np.append(np.minimum(at + _COUNTS.astype(np.int32)[choice], n), np.int32(n))
    second = after[after]
    fourth = memoryview(second[second])
    every, i = [], 0
    while i < n:
        every.append(i)
        i = fourth[i]
    every = np.array(every)
    starts = np.stack([every, after[every], second[every], after[second[every]]], axis=1).ravel()
    starts = starts[starts < n]
    used = choice[starts]
    words = used.astype(np.uint64) << np.uint64(60)
    for s in np.unique(used):
        count, bits = SELECTORS[s]
        if bits:
            mine = np.flatnonzero(used == s)
            own, first = words[mine], starts[mine]
            for k in range(count):
                own |= ids[first + k] << np.uint64(bits * k)
            words[mine] = own
    return words, np.flatnonzero(starts % block == 0).astype(np.int32)


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of whole blocks of words."""
    used = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(_COUNTS[used])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    for s in np.unique(used):
        count, bits = SELECTORS[s]
        if bits:
            mine = np.flatnonzero(used == s)
            own, first, ones = words[mine], ends[mine] - count, np.uint64((1 << bits) - 1)
            for k in range(count):
                out[first + k] = own >> np.uint64(bits * k) & ones
    return out


def write_token_files(df: DataFrame, path: str, make: Callable[[], Callable[[list[str]], list[bytes]]], end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Encode every text with ``make()`` (texts to ids, little-endian unsigned 32-bit), append ``end_id``, and write the files at ``path``.

    Documents go to ranges of their ids (nulls first; equal ids in order of their texts). A null text is empty and has
    the end id alone. An empty table writes files without records. A record ends with the document that fills it, so
    memory follows the longest document and RECORD_IDS.
    """
    small_batches(df.sparkSession)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(df[id_col].cast("bigint").alias("_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("_text"))
    ordered = rows.repartitionByRange(n, F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first(), "_text")
    arrow = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32())), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = make(), TaskContext.get().partitionId()
        ids, docs, lengths, seq, before = array("I"), [], [], 0, 0

        def record() -> pa.RecordBatch:
            words, offsets = pack(np.frombuffer(ids, dtype=np.uint32))
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "before": before, "n_ids": len(ids), "doc_ids": docs, "lengths": lengths, "offsets": offsets.tolist(), "words": words.astype("<u8").tobytes()}], schema=arrow)

        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                for doc, own in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                    ids.frombytes(own)
                    ids.append(end_id)
                    docs.append(doc)
                    lengths.append(len(own) // 4 + 1)
                    if len(ids) >= RECORD_IDS:
                        yield record()
                        seq, before = seq + 1, before + len(ids)
                        ids, docs, lengths = array("I"), [], []
        if docs:
            yield record()

    ordered.mapInArrow(run, SCHEMA).write.parquet(path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The records with ``start``, how many ids all records before it hold. Only the sums of whole parts are brought together, a row for each of the writer's tasks; that is what is broadcast."""
    files = spark.read.schema(SCHEMA).parquet(path)
    before_it = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("_sum")).select("part", F.coalesce(F.sum("_sum").over(before_it), F.lit(0)).alias("_base"))
    return files.join(F.broadcast(parts), "part").withColumn("start", F.col("_base") + F.col("before"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                start, docs, lengths, words = (batch.column(i)[k] for i in range(4))
                ids = unpack(np.frombuffer(words.as_py(), dtype="<u8")).astype("<u4").tobytes()
                sizes = lengths.values.to_numpy().astype(np.int64)
                ends = np.cumsum(sizes)
                first = ends - sizes
                yield pa.RecordBatch.from_arrays(
                    [docs.values, pa.array(first + start.as_py()), pa.array(sizes), pa.array([ids[4 * a : 4 * b] for a, b in zip(first.tolist(), ends.tolist(), strict=True)], type=pa.binary())], names=["doc_id", "start", "n_tokens", "ids"]
                )

    return _placed(spark, path).select("start", "doc_ids", "lengths", "words").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def read_ids(spark: SparkSession, path: str, start: int, n: int, block: int = BLOCK) -> DataFrame:
    """The ids from place ``start`` of all files' ids on, ``n`` of them or as many as there are: a row (start, ids) per record that has some.

    Records outside the span aren't read, and in the others only the blocks that reach into it are decoded, found by
    their offsets. ``block`` is the writer's.
    """
    low, high = max(start, 0), start + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                base, size, offsets, words = (batch.column(i)[k].as_py() for i in range(4))
                a, b = max(low - base, 0), min(high - base, size)
                first, last = a // block, -(-b // block)
                stop = offsets[last] if last < len(offsets) else len(words) // 8
                ids = unpack(np.frombuffer(words, dtype="<u8")[offsets[first] : stop]).astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array([base + a]), pa.array([ids[a - first * block : b - first * block].tobytes()], pa.binary())], names=["start", "ids"])

    inside = _placed(spark, path).where((F.col("start") < high) & (F.col("start") + F.col("n_ids") > low))
    return inside.select("start", "n_ids", "offsets", "words").mapInArrow(run, "start bigint, ids binary")
