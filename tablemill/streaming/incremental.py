"""Enrichment of a growing table: each micro-batch's pending rows are processed and their results appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tablemill.operators.infer import extracted
from tablemill.plans.enrich import Enrichment


def enrich_stream(table: DataFrame, plan: Enrichment, results_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Results of a streaming table's pending rows, as Parquet with a folder for each batch.

    A batch that is run again after a failure overwrites its own folder, so each row's results are there once. Its replies are beside
    the checkpoint by the batch's number: complete ones are used again, and of others what the tasks had logged, so that no row
    is sent twice. ``once`` takes what there is and stops.
    """

    def each(batch: DataFrame, number: int) -> None:
        replies = plan.replies(plan.pending(batch), f"{checkpoint.rstrip('/')}/replies/batch-{number}")
        extracted(replies, plan.spec.id_col, list(plan.spec.outputs)).write.mode("overwrite").parquet(f"{results_path}/batch={number}")

    writer = table.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def merge_stream(results: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand each batch of results to ``apply(batch, number)``, which must be harmless to repeat."""
    writer = results.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
