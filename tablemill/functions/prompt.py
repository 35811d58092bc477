"""Prompts: a row as compact JSON, put into a template, as chat messages."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACEHOLDER = "{record_json}"


def record_json(df: DataFrame, columns: Iterable[str], exclude: Iterable[str] = ()) -> Column:
    """Compact JSON of the columns, without nulls, excluded ones, and those whose names begin with ``_``."""
    out = set(exclude)
    names = [c for c in columns if c in df.columns and c not in out and not c.startswith("_")]
    return F.to_json(F.struct(*[df[f"`{c}`"] for c in names])) if names else F.lit("{}")


def render(template: Column | str, record: Column) -> Column:
    """Every placeholder replaced, literally. An empty or null template gives an empty prompt, which is an error later on."""
    made = F.lit(template) if isinstance(template, str) else template
    return F.coalesce(F.replace(made, F.lit(PLACEHOLDER), record), F.lit(""))


def messages(system: Column, user: Column) -> Column:
    """An array of (role, content): the system message only where it isn't empty."""
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array_compact(F.array(F.when(F.coalesce(system, F.lit("")) != "", said("system", system)), said("user", user)))


def messages_text(system: Column, user: Column) -> Column:
    """The contents of the messages, empty ones left out, joined by line ends: what is counted as input tokens."""
    some = lambda c: F.when(c != "", c)
    return F.concat_ws("\n", some(system), some(user))


def output_json(df: DataFrame, outputs: Mapping[str, str]) -> Column:
    """The output columns under their aliases as JSON, nulls left out and missing columns as empty text: what is counted as output tokens."""
    return F.to_json(F.struct(*[(df[f"`{c}`"] if c in df.columns else F.lit("")).alias(a) for a, c in outputs.items()]))


def stop_list(col: Column, is_array: bool) -> Column:
    """The stop sequences as an array, given as one string or an array of them."""
    return col if is_array else F.when(col.isNotNull(), F.array(col))
