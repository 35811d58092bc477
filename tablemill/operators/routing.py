"""Routing rows to profiles (prompt, rules, model) by the value of a field."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILE = "match string, template string, system_prompt string, model string, temperature double, required array<string>"
#: Keys that a profile may set.
ALLOWED = ("prompt", "validation")
#: Profiles come from one configuration; more than this isn't one.
MOST_PROFILES = 10_000


def profiles(spark: SparkSession, config: Mapping, subtasks: Sequence[Mapping[str, Any]]) -> DataFrame:
    """A row per profile, and one with a null match for the default. A subtask is {match, profile: {prompt, validation}}; the last of the same match counts."""
    if len(subtasks) > MOST_PROFILES:
        raise ValueError("too many profiles")

    def row(match: str | None, prompt: Mapping) -> tuple:
        return match, prompt.get("template", ""), prompt.get("system_prompt", ""), prompt.get("model", "auto"), float(prompt.get("temperature", 0.7)), list(prompt.get("required_fields", []))

    base = config.get("prompt", {})
    out = {None: row(None, base)}
    for sub in subtasks:
        profile = sub.get("profile", {})
        if unknown := set(profile) - set(ALLOWED):
            raise ValueError(f"a profile has only {', '.join(ALLOWED)}: {sorted(unknown)}")
        if sub.get("match") is None:
            raise ValueError("a subtask needs a match")
        out[str(sub["match"])] = row(str(sub["match"]), {**base, **profile.get("prompt", {})})
    return spark.createDataFrame(list(out.values()), PROFILE)


def route(df: DataFrame, field: str, known: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the columns of the profile whose match equals the field as text, or else of the default (null match).

    A null value never matches. The profiles are one configuration's, so they are broadcast; the default comes with
    each of them, which spares a second join.
    """
    columns = list(columns or [c for c in known.columns if c != "match"])
    default = known.where("match is null").first()
    wanted = F.col(f"`{field}`").cast("string")
    some = known.where("match is not null").select(F.col("match").alias("_match"), *[F.col(c).alias(f"_p_{c}") for c in columns])
    joined = df.join(F.broadcast(some), wanted == F.col("_match"), "left")
    other = lambda c: F.lit(default[c]).cast(known.schema[c].dataType) if default is not None else F.lit(None).cast(known.schema[c].dataType)
    hit = F.col("_match").isNotNull()
    return joined.select(*[df[f"`{c}`"] for c in df.columns], *[F.when(hit, F.col(f"_p_{c}")).otherwise(other(c)).alias(c) for c in columns], hit.alias("routed"))
