"""Token estimation: how many tokens the inputs of all or pending rows, and the outputs of processed rows, have."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.batches import small_batches
from tablemill.functions.emptiness import to_text
from tablemill.functions.prompt import messages_text, output_json, record_json, render
from tablemill.operators.predicates import processed, unprocessed
from tablemill.operators.stats import token_stats
from tablemill.plans.spec import TaskSpec, token_mode

Counter = Callable[[Column], Column]
#: Texts that are Python strings at a time.
SLICE = 64


def by_length(text: Column) -> Column:
    """Characters: a stand-in that needs no vocabulary."""
    return F.char_length(text).cast("bigint")


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def by_ranks(path: str, pattern: str) -> Counter:
    """Tokens by a file of merge ranks, in Arrow batches; the vocabulary is loaded once in each Python worker.

    Texts become Python strings SLICE at a time, so a worker holds the vocabulary, a batch and little else. Called
    non-deterministic, as a filter of the count would else be pushed below it and count each text again in a second worker.
    """

    def counts(texts: pa.Array) -> pa.Array:
        encode = _encoding(path, pattern).encode_ordinary
        out = []
        for lo in range(0, len(texts), SLICE):
            out += [len(encode(t)) if t else 0 for t in texts.slice(lo, SLICE).to_pylist()]
        return pa.array(out, pa.int64())

    return F.arrow_udf(counts, "bigint").asNondeterministic()


def input_tokens(df: DataFrame, spec: TaskSpec, template: str, system: str = "", count: Counter = by_length, exclude: tuple[str, ...] = ()) -> Column:
    """Tokens of the messages that a row would be sent as."""
    names = [c for c in spec.inputs if c in df.columns]
    return count(messages_text(F.lit(system), render(template, record_json(df, names, exclude))))


def output_tokens(df: DataFrame, spec: TaskSpec, count: Counter = by_length) -> Column:
    return count(output_json(df, spec.outputs))


def estimate(df: DataFrame, spec: TaskSpec, template: str, system: str = "", mode: str = "in", sample: int = -1, count: Counter = by_length) -> dict[str, DataFrame]:
    """One-row statistics: ``input_tokens`` (modes in and io) and ``output_tokens`` (out and io).

    With sample -1 every row counts for the inputs, whatever its state, and every processed row for the outputs. A
    sample is the first rows by id, pending or processed, and the total is carried on to all of these. No rows: zeros.
    """
    mode, out = token_mode(mode), {}
    if count is not by_length:
        small_batches(df.sparkSession)
    text = df.withColumns({c: to_text(df, c) for c in spec.inputs if c in df.columns and c != spec.id_col})
    if mode in ("in", "io"):
        rows, total = text, None
        if sample >= 0:
            pending = df.filter(unprocessed(df, spec))
            total = pending.count()
            rows = text.filter(unprocessed(df, spec)).orderBy(spec.id_col).limit(sample)
        out["input_tokens"] = token_stats(rows.select(input_tokens(rows, spec, template, system, count).alias("n")), "n", total)
    if mode in ("out", "io"):
        rows, total = df.filter(processed(df, spec)), None
        if sample >= 0:
            total = rows.count()
            rows = rows.orderBy(spec.id_col).limit(sample)
        out["output_tokens"] = token_stats(rows.select(output_tokens(rows, spec, count).alias("n")), "n", total)
    return out
