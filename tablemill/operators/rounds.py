"""Model calls in rounds: every row is tried once in a round, failed rows are read from their source again, and all tasks pause together.

A round is a map stage whose result is written. Between rounds, one aggregate says how many rows failed and how; it decides on the
pause. Rows that failed by API or system errors are joined with the source as it is then, those with unusable replies are sent as they were.
Rounds that are complete are found again by a run that starts over, and within a round the journal keeps the replies of tasks that died.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.operators.infer import ModelClient, Retry, infer
from tablemill.sources.files import complete

KINDS = ("api_error", "content_error", "system_error")
_SENT = ("prompt", "system_prompt", "model", "temperature", "required")


def written(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``: as it is if it was completed before, else made and written now."""
    if not complete(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def may_retry(retry: Retry) -> Column:
    """Whether a failed row has retries left for its class of error; tries_* count the retries that it had."""
    left = F.lit(False)
    for k in KINDS:
        left = F.when(F.col("_error_type") == k, F.col(f"tries_{k}") < retry.limits.get(k, 1)).otherwise(left)
    return F.col("_error").isNotNull() & left & (F.col("_error") != "prompt_generation_failed")


def infer_rounds(
    current: Callable[[], DataFrame], again: Callable[[DataFrame], DataFrame], make_client: Callable[[], ModelClient], id_col: str, workdir: str, required: Sequence[str] = (), rules: Mapping[str, Sequence] | None = None, retry: Retry | None = None, concurrency: int = 16, rps: float | None = None, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic, log: bool = True,
) -> DataFrame:
    """(id, reply_json, _error, _error_type, attempts, errors) of all rows, a row for each id.

    ``current()`` gives the rows to send first, with the id and what ``infer`` reads; ``again(ids)`` reads those with these ids from the source anew.
    An id that the source no longer has fails with ``reload_failed``. Ids are unique. Results, rounds and, with ``log``, the replies of running tasks are below ``workdir``, and a run over
    the same folder goes on where the last one stopped. The pause is one for all tasks: before the next round, if a row failed by an API error
    and the last pause is longer ago than the window.
    """
    retry = retry or Retry()
    once = Retry({k: 0 for k in KINDS}, 0.0, retry.window)
    workdir, paused, final, n = workdir.rstrip("/"), float("-inf"), [], 0
    out = [id_col, "reply_json", "_error", "_error_type", "attempts", "errors"]
    counters = {f"tries_{k}": F.lit(0) for k in KINDS} | {"history": F.array().cast("array<string>")}
    first = current()
    spark = first.sparkSession
    asked = written(spark, f"{workdir}/asked-0", lambda: first.withColumns(counters))
    while True:
        kept = [id_col, *counters]
        said = written(spark, f"{workdir}/said-{n}", lambda: infer(asked, make_client, kept, required, rules, once, concurrency, rps, journal=f"{workdir}/journal-{n}" if log else None))
        tries = sum((F.col(f"tries_{k}") for k in KINDS), F.lit(0))
        history = F.concat("history", "errors")
        told = said.withColumn("attempts", F.col("attempts") + tries).withColumn("errors", F.slice(history, F.greatest(F.size(history) - 4, F.lit(1)), 5))
        failed = told.where(may_retry(retry))
        final.append(told.where(~F.coalesce(may_retry(retry), F.lit(False))).select(*out))
        seen = failed.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_error_type") == "api_error").alias("api")).first()
        if not seen["n"]:
            break
        if not complete(spark, f"{workdir}/asked-{n + 1}") and seen["api"] and clock() - paused > retry.window:
            sleep(retry.pause)
            paused = clock()
        more = {f"tries_{k}": F.col(f"tries_{k}") + (F.col("_error_type") == k).cast("int") for k in KINDS}
        state = failed.withColumns(more).withColumn("history", F.col("errors"))
        sent = [c for c in _SENT if c in asked.columns]
        same = asked.select(id_col, *sent).join(state.where("_error_type = 'content_error'").select(*kept), id_col)
        reread = state.where("_error_type <> 'content_error'")
        fresh = again(reread.select(id_col))
        moved = reread.join(fresh.select(id_col, *sent, F.lit(True).alias("_there")), id_col, "left")
        rows = lambda: moved.select(id_col, *sent, *counters, "_there", "_error", "attempts", "errors").unionByName(same.withColumn("_there", F.lit(True)), allowMissingColumns=True)
        both = written(spark, f"{workdir}/asked-{n + 1}", rows)
        final.append(both.where("_there is null").select(id_col, F.lit(None).cast("string").alias("reply_json"), F.concat(F.lit("reload_failed: "), "_error").alias("_error"), F.lit("system_error").alias("_error_type"), "attempts", "errors"))
        asked, n = both.where("_there").drop("_there", "_error", "attempts", "errors"), n + 1
    result = final[0]
    for part in final[1:]:
        result = result.unionByName(part)
    return result
