"""Enum rules and required fields on columns, and the JSON schema that says the same to a model."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fits(kind: T.DataType, value) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, int):
        return isinstance(kind, T.IntegralType)
    if isinstance(value, float):
        return isinstance(kind, T.FractionalType)
    return isinstance(kind, T.StringType)


def enum_errors(df: DataFrame, rules: Mapping[str, Sequence]) -> Column:
    """Names of the fields whose value isn't allowed. Fields without a rule, or that don't exist, are fine; values must agree in type too, and case counts. A null is a value that no rule allows."""
    checks = []
    for field, allowed in rules.items():
        if field in df.columns:
            same = [v for v in allowed if _fits(df.schema[field].dataType, v)]
            ok = F.coalesce(F.col(f"`{field}`").isin(same), F.lit(False)) if same else F.lit(False)
            checks.append(F.when(~ok, F.lit(field)))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def missing_fields(record: Column, required: Iterable[str]) -> Column:
    """Required keys that a JSON object doesn't have; a null value counts as present. Text that isn't an object has none."""
    return F.array_except(F.array(*[F.lit(f) for f in required]).cast("array<string>"), F.coalesce(F.json_object_keys(record), F.array().cast("array<string>")))


def rule_sizes(rules: Mapping[str, Sequence]) -> dict[str, int]:
    return {field: len(values) for field, values in rules.items()}


def rules_from(table: DataFrame, field: str = "field", value: str = "value", most: int = 10_000) -> dict[str, list]:
    """Rules of a table with a row per field and allowed value, in order of the values. They are a configuration, so more than ``most`` are refused."""
    rows = table.select(field, value).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} allowed values")
    out: dict[str, list] = {}
    for f, v in sorted(map(tuple, rows)):
        out.setdefault(f, []).append(v)
    return out


def json_schema(required: Sequence[str], rules: Mapping[str, Sequence] | None = None) -> dict | None:
    """An object schema: fields with a rule have its values and their type (by the first), others are strings. None without fields."""
    if not required:
        return None
    kinds = ((bool, "boolean"), (int, "integer"), (float, "number"))
    out = {}
    for field in required:
        allowed = (rules or {}).get(field)
        out[field] = {"type": next((n for t, n in kinds if isinstance(allowed[0], t)), "string"), "enum": list(allowed)} if allowed else {"type": "string"}
    return {"type": "object", "properties": out, "required": list(required)}
