"""Quality rules for documents, and for the hosts (sources) that they come from.

Documents are measured one by one. Rule failures are then summed by host, and each host's failure rate is shrunk towards
all hosts' by a beta prior fitted to how much hosts differ beyond what counts of that size differ by chance. A host is
rejected with all its documents if its rate of any rule is, with high posterior probability, above a limit that follows
the mean of all hosts.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import WORD, fresh, map_rows, staged

_WORDS = re.compile(WORD).findall
_SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Further rules that only count against a host: symbols per 100 characters of words, and repeated lines.
MAX_SYMBOL_PERCENT, MAX_DUP_LINES = 10, 10
#: A host's limit is so many times the odds of failure of all documents, and no less than a quarter of its documents.
HOST_ODDS, LEAST_LIMIT = 6.0, 0.25
#: Standard deviations of the posterior by which a rate must exceed the limit: a probability of 0.99 in the normal approximation.
CERTAIN = 2.33
#: The prior's weight in documents, where hosts differ by as much as they can and where they don't differ beyond chance.
PRIOR_WEIGHT = (0.01, 1e9)

METRICS = [("n_words", "bigint", pa.int64()), ("word_chars", "bigint", pa.int64()), ("n_symbols", "bigint", pa.int64()), ("n_dup_lines", "bigint", pa.int64()), ("n_repeat_words", "bigint", pa.int64())]


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` (a power of two) words found twice or more.

    Windows are numbered exactly, by pairing the numbers of their halves.
    """
    n = len(words)
    if n <= window:
        return 0
    seen: dict[str, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    if len(seen) == n:
        return 0
    width = 1
    while width < window:
        numbered = np.unique(ids[:-width] * (n + 1) + ids[width:], return_inverse=True, return_counts=True)
        ids, counts = numbered[1], numbered[2]
        width *= 2
        if len(counts) == len(ids):
            return 0
    found = np.flatnonzero(counts[ids] > 1)
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[found] += 1
    edge[found + window] -= 1
    return int(np.count_nonzero(np.cumsum(edge)))


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    words = _WORDS(text or "")
    if not words:
        return 0, 0, sum(map((text or "").count, SYMBOLS)), 0, 0
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def rules(col: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """Each rule of a document, true where it fails; ``col`` finds a measure by its name."""
    words = col("n_words")
    return {
        "short": words < MIN_WORDS,
        "repeats": col("n_repeat_words") * 100 > words * MAX_REPEAT_PERCENT,
        "symbols": col("n_symbols") * 100 > col("word_chars") * MAX_SYMBOL_PERCENT,
        "dup_lines": col("n_dup_lines") > MAX_DUP_LINES,
    }


def host_verdicts(measured: DataFrame, host_col: str) -> DataFrame:
    """One row per host with its shrunk failure rate of each rule and ``host_rejected``. A null host gets no verdict. Staged, so that a join knows their size beforehand and broadcasts them if that is small."""
    each = rules()
    hosts = measured.where(F.col(host_col).isNotNull()).groupBy(host_col).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(f"_f_{r}") for r, c in each.items()])
    # one row of sums, whatever the number of hosts
    sums = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum("_n").alias("n"), F.sum(F.col("_n").cast("double") * F.col("_n")).alias("n2"), *[F.sum(f"_f_{r}").alias(f"f_{r}") for r in each], *[F.sum(F.col(f"_f_{r}") * F.col(f"_f_{r}") / F.col("_n")).alias(f"q_{r}") for r in each]).first()
    out, rejected = [F.col(host_col)], F.lit(False)
    n = sums["n"] or 1
    for r in each:
        mean = (sums[f"f_{r}"] or 0) / n
        # the rates' spread over hosts, less what is chance, as a variance between hosts
        within = mean * (1 - mean)
        free = n - (sums["n2"] or 0) / n
        between = ((sums[f"q_{r}"] or 0) - n * mean * mean - (sums["hosts"] - 1) * within) / free if free > 0 else 0.0
        weight = min(max(within / between - 1, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1]) if between > 0 else PRIOR_WEIGHT[1]
        limit = max(HOST_ODDS * mean / (1 - mean + HOST_ODDS * mean), LEAST_LIMIT)
        shrunk = (F.col(f"_f_{r}") + F.lit(mean * weight)) / (F.col("_n") + F.lit(weight))
        deviation = F.sqrt(F.greatest(shrunk * (1 - shrunk), F.lit(0.0)) / (F.col("_n") + F.lit(weight + 1)))
        out.append(F.round(shrunk, 6).alias(f"rate_{r}"))
        rejected = rejected | (shrunk - deviation * CERTAIN >= limit)
    return staged(hosts.select(*out, rejected.alias("host_rejected")), "hosts")


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: the id, the measures, base_failed, kept, the host's rate_* and host_rejected.

    base_failed: under 20 words, or over 30 % of the words in repeated windows. kept: not base_failed, and the host not
    rejected. A null text has no words and fails; a document with a null host is judged by itself alone, its rates are
    null. Repeated rows are judged alike and count once each for their host. Further columns are not read. The measures
    are staged, so the texts are read once.
    """
    rows = df.select(df[id_col].alias("_id"), df[host_col].cast("string").alias("_host"), df[text_col].alias("_text"))
    measured = staged(map_rows(rows, lambda: measure, "_text", METRICS, keep=["_id", "_host"]), "quality")
    each = rules()
    failed = each["short"] | each["repeats"]
    rejected = F.coalesce("host_rejected", F.lit(False))
    return measured.join(host_verdicts(measured, "_host"), "_host", "left").select(
        F.col("_id").alias(id_col), *[n for n, _, _ in METRICS], failed.alias("base_failed"), (~failed & ~rejected).alias("kept"), *[f"rate_{r}" for r in each], rejected.alias("host_rejected")
    )


def drop_rejected(df: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``df`` that ``quality_rules`` keeps, with all columns.

    Verdicts stay with their rows, so rows without an id, or with one that others have too, are judged each by itself.
    The measured rows are staged and only rejected hosts are joined: texts are shuffled only if these are too many to broadcast.
    """
    names = dict(zip([n for n, _, _ in METRICS], fresh(df, *(f"_{n}" for n, _, _ in METRICS)), strict=True))
    host, key, verdict = fresh(df, "_of_host", "_host", "_rejected")
    own = df.withColumn(host, F.col(f"`{host_col}`").cast("string"))
    measured = staged(map_rows(own, lambda: measure, text_col, [(names[n], ddl, kind) for n, ddl, kind in METRICS]), "measured")
    verdicts = host_verdicts(measured.select(F.col(host).alias(key), *[F.col(c).alias(n) for n, c in names.items()]), key)
    gone = staged(verdicts.where("host_rejected").select(key, F.col("host_rejected").alias(verdict)), "rejected-hosts")
    each = rules(lambda n: F.col(names[n]))
    good = ~(each["short"] | each["repeats"]) & ~F.coalesce(verdict, F.lit(False))
    return measured.join(gone, F.col(host) == F.col(key), "left").where(good).select(*[F.col(f"`{c}`") for c in df.columns])
