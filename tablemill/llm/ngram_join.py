"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles. Equal sets are collapsed first. MinHash bands propose candidates: the members
of a bucket, all with all, are compared by their signatures in tiles of bounded size: MinHash values are read a step at
a time, and a pair is dropped once the posterior probability that its similarity reaches the threshold is below the
tolerance. A tile gives a spanning forest of the pairs that stay, never the pairs, and what forests connect is a
neighbourhood, about as tight as a class. Within it, pairs are compared in the same way and those left are verified on
their whole sets; these tiles give sums and forests.

Buckets with the same members count once. A bucket of more than SIG_BLOCK members is cut by set size (sets that reach
the threshold differ in size by its ratio at most) and then into blocks, each pair of which is a tile.

What may be missed: a pair at the threshold shares none of the bands with probability 5e-8, and pruning errs with the
tolerance. Nothing else is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import WORD, map_rows, place_of, rows_that_stay, staged, text_of
from tablemill.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP, TOLERANCE = 32, 1e-6
#: A block of a bucket has about so many signatures.
SIG_BLOCK = 4096
#: A block of a neighbourhood has about so many sets, or fewer if they hold more shingles.
TILE_SETS, TILE_SHINGLES = 256, 1 << 18
_WORDS = re.compile(WORD).findall
_LOWER = {c: c + 32 for c in range(65, 91)}
_FACTORS = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the text's shingles, A-Z lower-cased; a text of fewer words is one shingle, one of none has none."""
    words = _WORDS(text.translate(_LOWER) if not text.isascii() else text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    own: dict[str, int] = {}
    for w in words:
        if w not in own:
            own[w] = xxhash.xxh3_64_intdigest(w)
    h = np.array([own[w] for w in words], dtype=np.uint64)
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = (out ^ h[k : k + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out * _END)


def minhash(hashes: np.ndarray) -> np.ndarray:
    """The low halves of the 32-bit minima."""
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(hashes), 256):
        turned = (hashes[lo : lo + 256, None] * _FACTORS) >> np.uint64(32)
        np.minimum(least, turned.min(axis=0).astype(np.uint32), out=least)
    return least.astype(np.uint16)


@lru_cache
def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each step, how many of the MinHash values read so far must agree for the pair to stay.

    With a uniform prior, m agreements of k make the similarity's posterior Beta(m + 1, k - m + 1); the probability that
    it reaches the threshold is a binomial tail.
    """
    out = []
    for k in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        out.append(m)
    return out


def may_reach(a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float = TOLERANCE) -> np.ndarray:
    """Which rows of two equally long arrays of signatures stay, read step by step."""
    alive = np.arange(len(a))
    agree = np.zeros(len(a), dtype=np.int64)
    for k, least in enumerate(least_matches(threshold, tolerance)):
        at = slice(k * STEP, (k + 1) * STEP)
        agree[alive] += (a[alive, at] == b[alive, at]).sum(axis=1)
        alive = alive[agree[alive] >= least]
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right, by products of 0/1 matrices a few columns wide."""
    sizes = [len(s) for s in left], [len(s) for s in right]
    both = np.concatenate([*left, *right])
    n_left = sum(sizes[0])
    _, column = np.unique(both, return_inverse=True)
    on_both = np.bincount(column[:n_left], minlength=len(both)).astype(bool) & np.bincount(column[n_left:], minlength=len(both)).astype(bool)
    renumbered = np.cumsum(on_both) - 1
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    parts = []
    for cols, own in ((column[:n_left], sizes[0]), (column[n_left:], sizes[1])):
        rows = np.repeat(np.arange(len(own)), own)
        keep = on_both[cols]
        rows, cols = rows[keep], renumbered[cols[keep]]
        order = np.argsort(cols, kind="stable")
        parts.append((rows[order], cols[order], len(own)))
    for lo in range(0, int(on_both.sum()), 2048):
        dense = []
        for rows, cols, n in parts:
            a, b = np.searchsorted(cols, (lo, lo + 2048))
            m = np.zeros((n, 2048), dtype=np.float32)
            m[rows[a:b], cols[a:b] - lo] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def linked(sigs: np.ndarray, sets: list[np.ndarray], side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile that reach the threshold, as two arrays of places. ``side`` is false for the first block's sets; a tile of one block compares it with itself."""
    first, second = np.flatnonzero(~side), np.flatnonzero(side)
    alone = not len(second)
    if alone:
        second = first
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    found_a, found_b = [], []
    for place, a in enumerate(first):
        b = second[place + 1 :] if alone else second
        b = b[np.minimum(sizes[b], sizes[a]) >= threshold * np.maximum(sizes[b], sizes[a])]
        if len(b):
            b = b[may_reach(np.broadcast_to(sigs[a], (len(b), HASHES)), sigs[b], threshold)]
            found_a.append(np.full(len(b), a))
            found_b.append(b)
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    if len(a) > 400:
        rows, cols = np.unique(a), np.unique(b)
        common = _overlaps([sets[i] for i in rows], [sets[i] for i in cols])[np.searchsorted(rows, a), np.searchsorted(cols, b)].astype(np.int64)
    else:
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], dtype=np.int64)
    reach = common / np.maximum(sizes[a] + sizes[b] - common, 1) >= threshold
    return a[reach], b[reach]


def spanning(sigs: np.ndarray, sizes: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of places, of the pairs that may reach the threshold.

    A place is compared with those that aren't reached yet, so like signatures cost a comparison each and not all pairs.
    """
    left, out = np.arange(len(sigs)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            fits = np.minimum(sizes[left], sizes[x]) >= threshold * np.maximum(sizes[left], sizes[x])
            at = np.flatnonzero(fits)
            if len(at):
                at = at[may_reach(np.broadcast_to(sigs[x], (len(at), HASHES)), sigs[left[at]], threshold)]
                hit = left[at].tolist()
                out += [(x, y) for y in hit]
                queue += hit
                left = np.delete(left, at)
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            above[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _signed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _place, _digest of the shingle set, _n, _sig."""

    def make():
        def one(text):
            s = shingles(text)
            return xxhash.xxh3_128_digest(s.tobytes()), len(s), minhash(s).tobytes() if len(s) else None

        return one

    ident, text = df[id_col].cast("bigint"), text_of(df, text_col)
    rows = df.select(ident.alias("_id"), place_of(ident, text).alias("_place"), text.alias("_text"))
    return map_rows(rows, make, "_text", [("_digest", "binary", pa.binary()), ("_n", "int", pa.int32()), ("_sig", "binary", pa.binary())], keep=["_id", "_place"])


def _banded(reps: DataFrame) -> DataFrame:
    """(key, rep) for each band of each signature."""
    schema = pa.schema([("key", pa.int64()), ("rep", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = np.arange(1, BANDS + 1, dtype=np.uint64) * _END
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                # a band's four values fill a key; the steps after that can be undone, so different values have different keys
                key = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint64).reshape(-1, BANDS) ^ band
                key = key * _MIX
                key ^= key >> np.uint64(31)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], schema=schema)

    return reps.select("rep", "_sig").mapInArrow(run, "key bigint, rep bigint")


def _buckets(reps: DataFrame, threshold: float) -> DataFrame:
    """(key, cut, i, j, rep): the members of every bucket, dealt to tiles."""
    bands = _banded(reps)
    shared = bands.groupBy("key").agg(F.min("rep").alias("_least"), F.max("rep").alias("_most"), F.count(F.lit(1)).alias("_size")).where("_least < _most").select("key", "_size")
    members = staged(bands.join(shared, "key").select("key", "rep", "_size"), "buckets")
    same = members.groupBy("key").agg(F.first("_size").alias("_n"), F.bit_xor(F.xxhash64("rep")).alias("_x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("_y"))
    chosen = same.groupBy("_n", "_x", "_y").agg(F.min("key").alias("key")).select("key")
    members = staged(members.join(chosen, "key"), "different-buckets")
    small = members.where(F.col("_size") <= SIG_BLOCK).select("key", F.lit(0).alias("cut"), F.lit(0).alias("i"), F.lit(0).alias("j"), "rep")
    step = F.floor(F.ln(F.col("_n")) / F.lit(-log(threshold) * (1 + 1e-9))).cast("int")
    hot = members.where(F.col("_size") > SIG_BLOCK).join(reps.select("rep", "_n"), "rep").select("key", "rep", F.explode(F.array(step, step + 1)).alias("cut"))
    blocks = hot.groupBy("key", "cut").agg(F.ceil(F.count(F.lit(1)) / SIG_BLOCK).cast("int").alias("_blocks"))
    return small.unionByName(_tiled(hot.join(blocks, ["key", "cut"])).select("key", "cut", "i", "j", "rep"))


def _tiled(rows: DataFrame) -> DataFrame:
    """Add block, i and j to rows with rep and _blocks: each row once for every pair of blocks that has its own."""
    placed = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int")).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return placed.withColumn("i", F.least("block", "_with")).withColumn("j", F.greatest("block", "_with"))


def _grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with the same first ``n_keys`` columns, which are one after the other: the key, and the rest of each row."""
    now, rows = None, []
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            for r in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True):
                if r[:n_keys] != now:
                    if rows:
                        yield now, rows
                    now, rows = r[:n_keys], []
                rows.append(r[n_keys:])
    if rows:
        yield now, rows


def _neighbourhoods(reps: DataFrame, threshold: float) -> DataFrame:
    """(rep, component) of all that have a candidate which may reach the threshold."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for _, rows in _grouped(batches, 4):
            if len(rows) > 1:
                sigs = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint16).reshape(-1, HASHES)
                for a, b in spanning(sigs, np.array([r[1] for r in rows], dtype=np.int64), threshold):
                    u.append(rows[a][0])
                    v.append(rows[b][0])
            if len(u) >= 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=schema)
                u, v = [], []
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=schema)

    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tile = ["key", "cut", "i", "j"]
    signed = _buckets(reps, threshold).join(reps.select("rep", "_n", "_sig"), "rep")
    laid = signed.repartition(n, *tile).sortWithinPartitions(*tile).select(*tile, "rep", "_n", "_sig")
    return components(laid.mapInArrow(run, "u bigint, v bigint")).withColumnRenamed("node", "rep")


def _with_sets(members: DataFrame) -> DataFrame:
    """Rows with a ``_text`` as rows with its shingles (``_set``), made once before rows are dealt to tiles."""
    kept = [c for c in members.columns if c != "_text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in members.select(*kept).schema.fields), "_set binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                sets = [shingles(t).tobytes() for t in batch.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sets, pa.binary())], names=[*kept, "_set"])

    return members.select(*kept, "_text").mapInArrow(run, schema)


def _verified(tiles: DataFrame, threshold: float) -> DataFrame:
    """(rep, links, other): links to others, in copies, and edges of spanning forests. ``tiles`` has component, i, j, block, rep, copies, _sig, _set."""
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, _), rows in _grouped(batches, 3):
            if len(rows) < 2:
                continue
            sigs = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint16).reshape(-1, HASHES)
            a, b = linked(sigs, [np.frombuffer(r[4], dtype=np.uint64) for r in rows], np.array([r[0] != i for r in rows]), threshold)
            copies = np.array([r[2] for r in rows], dtype=np.int64)
            links = np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))
            edges = _forest(a, b)
            some = np.flatnonzero(links)
            ids = [rows[k][1] for k in some] + [rows[k][1] for k, _ in edges]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([int(links[k]) for k in some] + [0] * len(edges), pa.int64()), pa.array([None] * len(some) + [rows[k][1] for _, k in edges], pa.int64())], schema=schema
            )

    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = tiles.repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j")
    return laid.select("component", "i", "j", "block", "rep", "copies", "_sig", "_set").mapInArrow(run, "rep bigint, links bigint, other bigint")


def _judged(df: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """A row per input row: _id, _place, _n, links, and _best, the row (_none, _id, _place) of the smallest id in its class (null without shingles)."""
    signed = staged(_signed(df, id_col, text_col), "signatures")
    least = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_place")).alias("_least")
    # a number for each different set, fixed by being written: ids can repeat or be null
    sets = signed.where("_n > 0").groupBy("_digest").agg(least, F.count(F.lit(1)).alias("copies"), F.first("_n").alias("_n"), F.first("_sig").alias("_sig"))
    sets = staged(sets.withColumn("rep", F.monotonically_increasing_id()), "sets")
    near = staged(_neighbourhoods(sets, threshold), "neighbourhoods")
    members = near.join(sets.select("rep", "copies", "_n", "_sig", F.col("_least._place").alias("_place")), "rep")
    blocks = members.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE_SETS), F.ceil(F.sum("_n") / TILE_SHINGLES)).cast("int").alias("_blocks"))
    text = text_of(df, text_col)
    texts = df.select(place_of(df[id_col].cast("bigint"), text).alias("_place"), text.alias("_text"))
    with_text = members.join(blocks, "component").join(texts, "_place").dropDuplicates(["_place"]).drop("_place")
    compared = staged(_verified(_tiled(_with_sets(with_text)), threshold), "tiles")
    classes = components(compared.where("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v"))).withColumnRenamed("node", "rep")
    links = compared.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    known = sets.select("_digest", "rep", "copies", "_least").join(classes, "rep", "left").join(links, "rep", "left").withColumn("_class", F.coalesce("component", "rep"))
    # a key of its own for the side with a row per class, so that Spark can split the sets of a large class
    best = known.groupBy("_class").agg(F.min("_least").alias("_best")).select(F.bitwise_not("_class").alias("_of"), "_best")
    known = known.join(best, F.bitwise_not("_class") == F.col("_of")).select("_digest", "copies", "links", "_best")
    return signed.join(known, "_digest", "left").select("_id", "_place", "_n", F.when(F.col("_n") > 0, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).alias("links"), "_best")


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: the id, class_id (smallest id of the rows that links connect it with), n_links (other rows at ``threshold`` or above, copies included), n_shingles.

    Each row is a document: rows that repeat an id, with the same text or another, are compared like any others, and so are rows
    without an id. A class of such rows alone has a null class_id. A null or empty text has no shingles, no links and its
    own class. Other columns are not read; an empty table gives no rows.
    """
    return _judged(df, id_col, text_col, threshold).select(F.col("_id").alias(id_col), F.when(F.col("_n") > 0, F.col("_best._id")).otherwise(F.col("_id")).alias("class_id"), F.col("links").alias("n_links"), F.col("_n").alias("n_shingles"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with all columns: that of the smallest id, which is null only if no row of the class has one.

    Rows without shingles are classes of their own and stay. Of rows that share id and text, one stays.
    """
    judged = _judged(df, id_col, text_col, threshold).where("_n > 0")
    by_place = judged.groupBy("_place").agg(F.bool_or(F.col("_place") == F.col("_best._place")).alias("_stays"), F.count(F.lit(1)).alias("_n"))
    return rows_that_stay(df, place_of(df[id_col].cast("bigint"), text_of(df, text_col)), by_place)
