"""Periodic runs of words by harmonic grid probing.

A stretch of a period p of at least twice that length has its words equal to those p places on for p places in a row, so one
of these places is a multiple of p. For each p only the places jp are tried, n ln n of them for all p together. Places that
may lie in a run (a few more probes to one side hold) are extended both ways by chunked array comparison; those within
a run of a period that divides p are skipped, as they would give the same stretch again.

Texts of up to 2 MiB are probed together, longest first, with a word of its own between them which nothing equals: a run
can't cross it, and for a period p only the texts of 2p words or more are looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tablemill.llm.common import small_batches

#: A run has so many words at least.
MIN_WORDS = 12
_FIRST_CHUNK, _LARGEST_CHUNK = 32, 1 << 16
#: Texts are probed together up to so many bytes.
_TOGETHER = 2 << 20


def _ahead(w: np.ndarray, i: int, p: int) -> int:
    """The first place from i on whose word isn't that p places on."""
    size = _FIRST_CHUNK
    while i + p < len(w):
        there = w[i + p : i + p + size]
        differ = w[i : i + len(there)] != there
        k = int(differ.argmax())
        if differ[k]:
            return i + k
        i += len(there)
        size = min(2 * size, _LARGEST_CHUNK)
    return i


def _behind(w: np.ndarray, i: int, p: int) -> int:
    """The first of the places up to i that all have the words p places on."""
    size = _FIRST_CHUNK
    while i > 0:
        lo = max(0, i - size)
        differ = (w[lo:i] != w[lo + p : i + p])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return i - k
        i = lo
        size = min(2 * size, _LARGEST_CHUNK)
    return i


def _likely(w: np.ndarray, at: np.ndarray, p: int) -> np.ndarray:
    """Those of the places that may lie in a stretch that is long enough: it reaches at least half of its least length to one side."""
    half = max(p, MIN_WORDS - p) // 2
    last = len(w) - 1 - p
    for steps in ((half,), (half // 2, 1, 2)):
        right = left = True
        for step in steps:
            on, back = np.minimum(at + step, last), np.maximum(at - step, 0)
            right = right & (w[on] == w[on + p])
            left = left & (w[back] == w[back + p])
        at = at[right | left]
        if not len(at):
            break
    return at


def runs_of(w: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, end, period) in ``w``: texts of ``sizes`` words, falling, each with a word of its own after it."""
    found: list[tuple[int, int, int]] = []
    due: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # runs by the next multiple of their period
    ends = np.cumsum(sizes + 1)
    texts = len(sizes)
    for p in range(1, int(sizes[0]) // 2 + 1 if texts else 0):
        while sizes[texts - 1] < 2 * p:
            texts -= 1
        grid = w[: ends[texts - 1] : p]
        same = grid[:-1] == grid[1:]
        for run in due.pop(p, ()):
            start, end, q = run
            same[-(-start // p) : max(0, (end - 1 - p) // p + 1)] = False
            if p + q < end - start:
                due[p + q].append(run)
        at = np.flatnonzero(same) * p
        if not len(at):
            continue
        past = 0
        for i in _likely(w, at, p).tolist():
            if i < past:
                continue
            past, start = _ahead(w, i, p), _behind(w, i, p)
            end = past + p
            if end - start >= max(MIN_WORDS, 2 * p):
                found.append((start, end, p))
                if 2 * p < end - start:
                    due[2 * p].append(found[-1])
    return found


def _found(texts: list[str | None]) -> list[tuple[list[dict], str]]:
    words = [(t or "").encode().split() for t in texts]  # the white space of bytes is just the six characters
    order = sorted(range(len(words)), key=lambda k: -len(words[k]))
    order = [k for k in order if len(words[k]) >= MIN_WORDS]
    sizes = np.array([len(words[k]) for k in order], dtype=np.int64)
    code = defaultdict(count().__next__)
    w = np.empty(int(sizes.sum()) + len(sizes), dtype=np.int32)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    for n, k in enumerate(order):
        w[begins[n] : begins[n + 1] - 1] = np.fromiter(map(code.__getitem__, words[k]), np.int32, len(words[k]))
        w[begins[n + 1] - 1] = -1 - n
    by_text: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    found = runs_of(w, sizes)
    for n, (start, end, p) in zip(np.searchsorted(begins, [r[0] for r in found], "right") - 1, found, strict=True):
        by_text[order[n]].append((start - int(begins[n]), p, end - start))
    out = []
    for k, these in enumerate(words):
        runs = sorted(by_text.get(k, ()))
        if runs:
            depth = np.zeros(len(these) + 1, dtype=np.int32)
            np.add.at(depth, [s + p for s, p, _ in runs], 1)
            np.add.at(depth, [s + length for s, _, length in runs], -1)
            these = [these[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
        out.append(([{"start": s, "length": length, "period": p} for s, p, length in runs], b" ".join(these).decode()))
    return out


def _sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have about _TOGETHER bytes at most, or one row."""
    for batch in batches:
        ends = np.cumsum(np.array([v or 0 for v in pc.binary_length(batch.column(column)).to_pylist()], dtype=np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _TOGETHER, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def periodic_runs(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``runs``, an array of (start, length, period) by start and period, and ``collapsed`` to every row.

    Words are maximal runs of characters outside the six ASCII white-space characters, numbered from 0. A run is a stretch
    of words with smallest period p and at least max(12, 2p) words that can't be extended; runs may overlap.
    ``collapsed`` is the words that no run contains after its first p words, joined by one space. A null text has no words.
    Rows don't meet, so repeated rows and null ids play no part; input columns of these two names are replaced. No shuffle.
    Memory follows an Arrow batch, which is bounded in rows and bytes, and 2 MiB of text or one longer text being probed.
    """
    small_batches(df.sparkSession)
    kept = [c for c in (df.columns if keep is None else keep) if c not in ("runs", "collapsed")]
    read = df.select(*[f"`{c}`" for c in kept], df[text_col].cast("string").alias("collapsed"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, len(kept)):
            got = _found(batch.column(len(kept)).to_pylist())
            made = [pa.array([g[0] for g in got], pa.list_(run)), pa.array([g[1] for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + made, names=[*kept, "runs", "collapsed"])

    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[:-1]]
    return read.mapInArrow(each, ", ".join([*ddl, "runs array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed string"]))
