"""Batch enrichment: from a configuration to a table with its blank outputs filled in."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.functions.emptiness import to_text
from tablemill.functions.prompt import record_json, render
from tablemill.operators.columns import with_outputs
from tablemill.operators.infer import ModelClient, Retry, extracted, infer
from tablemill.operators.merge import write_back
from tablemill.operators.predicates import reload, unprocessed
from tablemill.operators.rounds import infer_rounds, written
from tablemill.operators.routing import profiles, route
from tablemill.operators.stats import counts
from tablemill.plans.spec import configured, spec_of
from tablemill.plans.tokens import by_length, by_ranks, estimate
from tablemill.sources.registry import open_source


class Enrichment:
    """One run over one table.

    Everything up to the model calls is one plan: scan, filter, projection, a broadcast join with the profiles, prompts.
    Replies are written before they are used, so that no later failure calls the model again; then they are merged by id.
    """

    def __init__(self, spark: SparkSession, config: Mapping[str, Any], make_client: Callable[[], ModelClient], workdir: str, make_reread: Callable | None = None):
        self.make_reread = make_reread
        self.spark, self.config, self.make_client, self.workdir = spark, configured(config), make_client, workdir.rstrip("/")
        self.spec = spec_of(self.config)
        limits = self.config["datasource"]["concurrency"]
        self.retry = Retry(dict(limits["retry_limits"]), limits["api_pause_duration"], limits["api_error_trigger_window"])

    def pending(self, table: DataFrame, all_rows: bool = False) -> DataFrame:
        """(id, prompt, system_prompt, model, temperature, required) of the rows still to be processed, or of all."""
        base = with_outputs(table, self.spec)
        routing = self.config["routing"]
        field = routing["field"] if routing["enabled"] else None
        names = [c for c in self.spec.inputs if c in base.columns]
        rows = base if all_rows else base.filter(unprocessed(base, self.spec))
        if self.config["datasource"].get("stringify", True):
            rows = rows.withColumns({c: to_text(rows, c) for c in names if c != self.spec.id_col})
        exclude = [field] if field and field not in self.config["columns_to_extract"] else []
        made = rows.select(F.col(self.spec.id_col).alias("_id"), *([F.col(f"`{field}`").cast("string").alias("_route")] if field else []), record_json(rows, names, exclude).alias("_record"))
        known = profiles(self.spark, self.config, routing["subtasks"] if field else [])
        routed = route(made if field else made.withColumn("_route", F.lit(None).cast("string")), "_route", known)
        return routed.select(F.col("_id").alias(self.spec.id_col), render(F.col("template"), F.col("_record")).alias("prompt"), "system_prompt", "model", "temperature", "required")

    def _rules(self) -> Mapping:
        return self.config["validation"]["field_rules"] if self.config["validation"]["enabled"] else {}

    def replies(self, pending: DataFrame, path: str | None = None) -> DataFrame:
        """Model replies of pending rows, written to and read from a folder, by default a new one in the working folder.

        A folder that has complete replies is read and nothing is called. While tasks run, they log replies beside it, which tasks that are tried again use
        (unless ``journal`` is false in the section on concurrency, for stores that Arrow can't write to).
        """
        limits = self.config["datasource"]["concurrency"]
        path = path or f"{self.workdir}/replies-{uuid.uuid4().hex}"
        out = lambda: infer(pending, self.make_client, [self.spec.id_col], self.config["prompt"]["required_fields"], self._rules(), self.retry, limits["batch_size"], limits.get("rps"), self.make_reread, journal=f"{path}-journal" if limits.get("journal", True) else None)
        return written(self.spark, path, out)

    def replies_in_rounds(self, source: Callable[[], DataFrame], name: str | None = None, **how: Any) -> DataFrame:
        """Model replies, with failed rows read again from ``source()`` between rounds. A run of a name that was there before goes on where that stopped."""
        limits = self.config["datasource"]["concurrency"]

        def again(ids: DataFrame) -> DataFrame:
            return self.pending(reload(source(), ids, self.spec.id_col), all_rows=True)

        return infer_rounds(
            lambda: self.pending(source()), again, self.make_client, self.spec.id_col, f"{self.workdir}/{name or f'rounds-{uuid.uuid4().hex}'}", self.config["prompt"]["required_fields"], self._rules(), self.retry, limits["batch_size"], limits.get("rps"), **{"log": limits.get("journal", True)} | how
        )

    def run_source(self, name: str | None = None, on_failure: str = "mark", missing: str = "keep", **how: Any) -> tuple[DataFrame, DataFrame]:
        """Like ``run`` over the configured data source, in rounds: it is opened anew for what failed, and for the final merge."""
        source = lambda: open_source(self.spark, self.config["datasource"])
        replies = self.replies_in_rounds(source, name, **how)
        results = extracted(replies, self.spec.id_col, list(self.spec.outputs))
        return write_back(source(), results, self.spec, missing=missing, on_failure=on_failure), self.summary(replies)

    def run(self, table: DataFrame, on_failure: str = "mark", missing: str = "keep") -> tuple[DataFrame, DataFrame]:
        """(the table with its outputs filled in, one row of figures about the run)."""
        replies = self.replies(self.pending(table))
        results = extracted(replies, self.spec.id_col, list(self.spec.outputs))
        done = write_back(table, results, self.spec, missing=missing, on_failure=on_failure)
        return done, self.summary(replies)

    @staticmethod
    def summary(replies: DataFrame) -> DataFrame:
        """n_tasks, n_ok, n_failed, n_retries, success_rate, and failures by class of error."""
        n = F.count(F.lit(1))
        kinds = [F.count_if(F.col("_error_type") == k).alias(f"n_{k}") for k in ("api_error", "content_error", "system_error")]
        return replies.agg(n.alias("n_tasks"), F.count_if(F.col("_error").isNull()).alias("n_ok"), F.count_if(F.col("_error").isNotNull()).alias("n_failed"), F.coalesce(F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))), F.lit(0)).alias("n_retries"), F.coalesce(F.count_if(F.col("_error").isNull()) / F.nullif(n, F.lit(0)), F.lit(1.0)).alias("success_rate"), *kinds)

    def progress(self, table: DataFrame) -> DataFrame:
        base = with_outputs(table, self.spec)
        return counts(base, self.spec)

    def tokens(self, table: DataFrame) -> dict[str, DataFrame]:
        """Statistics of input and output tokens as the ``token_estimation`` section says: mode, sample_size, and vocabulary (a file of ranks) with its pattern, or else characters."""
        said = self.config["token_estimation"]
        count = by_ranks(said["vocabulary"], said["pattern"]) if said.get("vocabulary") else by_length
        prompt = self.config["prompt"]
        return estimate(with_outputs(table, self.spec), self.spec, prompt["template"], prompt["system_prompt"], said["mode"], said["sample_size"], count)
