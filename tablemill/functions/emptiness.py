"""What counts as an empty cell, and how cells become text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode-aware stripping sees it: ASCII, separators, U+001C to U+001F and U+0085. U+200B isn't white space.
BLANK = r"^[\s\p{Z}\x{1c}-\x{1f}\x{85}]*$"


def is_empty(df: DataFrame, name: str, mode: str = "blank") -> Column:
    """True where the cell is empty; a column that doesn't exist is empty everywhere.

    ``blank``: null, NaN, white space only, or an array or map without elements. ``sql``: null or the empty string,
    which every SQL store can evaluate. Zero and false are values.
    """
    if mode not in ("blank", "sql"):
        raise ValueError(f"unknown emptiness mode: {mode}")
    if name not in df.columns:
        return F.lit(True)
    col, kind = df[f"`{name}`"], df.schema[name].dataType
    null = col.isNull()
    if isinstance(kind, T.StringType):
        return null | (col == "" if mode == "sql" else col.rlike(BLANK))
    if mode == "sql":
        return null
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return null | F.isnan(col)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return null | (F.size(col) == 0)
    return null


def to_text(df: DataFrame, name: str) -> Column:
    """The cell as text: empty for null and NaN, lists joined by ``, `` (of their elements' text or name), structs by their text or else link."""
    if name not in df.columns:
        return F.lit("")
    return _text(df[f"`{name}`"], df.schema[name].dataType)


def _text(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.array_join(F.transform(col, lambda x: _text(x, kind.elementType)), ", "), F.lit(""))
    if isinstance(kind, T.StructType):
        known = [col[n].cast("string") for n in ("text", "name", "link") if n in kind.names]
        return F.coalesce(*known, F.to_json(col), F.lit(""))
    if isinstance(kind, T.MapType):
        known = [F.try_element_at(col, F.lit(n)).cast("string") for n in ("text", "name", "link")] if isinstance(kind.keyType, T.StringType) else []
        return F.coalesce(*known, F.to_json(col), F.lit(""))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(col), F.lit("")).otherwise(F.coalesce(col.cast("string"), F.lit("")))
    if isinstance(kind, T.NullType):
        return F.lit("")
    return F.coalesce(col.cast("string"), F.lit(""))


def known_text(col: Column) -> Column:
    """Stripped text, null where nothing is left."""
    return F.nullif(F.regexp_replace(col.cast("string"), r"^[\s\p{Z}\x{1c}-\x{1f}\x{85}]+|[\s\p{Z}\x{1c}-\x{1f}\x{85}]+$", ""), F.lit(""))
