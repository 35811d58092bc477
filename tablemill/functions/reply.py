"""Model replies: finding JSON in them, strictly parsed, and held against required fields and allowed values.

What regular expressions can do is an expression; strict parsing is Python's, in an Arrow-batched function, because
Spark's JSON functions accept trailing text and single quotes and refuse repeated keys.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How JSON is looked for in a reply.
FENCE = r"(?is)```(?:json)?\s*(\{.*?\})\s*```"
TRAILING_COMMA = r",\s*([}\]])"
OBJECT = r"(?s)(\{.*?\})"

#: What a scan for braces has to see: a backslash takes the next character with it.
_MARKS = re.compile(r'(?s)\\.|["{}]')

PARSED = "data_json string, error string, error_type string, validation_errors array<string>"


def fenced(reply: Column) -> Column:
    """The object in the first fenced block, empty if there is none."""
    return F.regexp_extract(reply, FENCE, 1)


def without_trailing_commas(text: Column) -> Column:
    """Commas before a closing brace or bracket removed, inside of strings too."""
    return F.regexp_replace(text, TRAILING_COMMA, "$1")


def object_candidates(reply: Column) -> Column:
    """All shortest ``{...}`` in order; an object with an object in it comes out cut short."""
    return F.regexp_extract_all(reply, F.lit(OBJECT), F.lit(1))


def stream_text(events: Column) -> Column:
    """The text of a server-sent stream of chat deltas."""
    lines = F.transform(F.split(events, "\r?\n"), lambda x: F.regexp_extract(x, r"^data:\s*(.*)$", 1))
    said = F.filter(lines, lambda x: (x != "") & (F.trim(x) != "[DONE]"))
    return F.array_join(F.transform(said, lambda x: F.coalesce(F.get_json_object(x, "$.choices[0].delta.content"), F.lit(""))), "")


def same_value(value, allowed) -> bool:
    """Equal in type and value: true isn't 1 and 1 isn't 1.0."""
    return type(value) is type(allowed) and value == allowed


def value_errors(data: Mapping, rules: Mapping[str, Sequence]) -> list[str]:
    """One message per field that has a rule, is present and isn't allowed."""
    return [f"{f}: {data[f]!r} ({type(data[f]).__name__}) is not allowed" for f, allowed in rules.items() if f in data and not any(same_value(data[f], a) for a in allowed)]


def _load(text: str) -> dict | None:
    try:
        data = json.loads(re.sub(TRAILING_COMMA, r"\1", text))
    except (ValueError, RecursionError):
        return None
    return data if isinstance(data, dict) else None


def balanced_objects(text: str) -> Iterator[str]:
    """Outermost ``{...}`` whose braces match outside of strings, in order.

    A brace that is never closed hides nothing: what closes within it is found by itself. Every character is read once.
    """
    opened: list[int] = []
    found: list[tuple[int, int]] = []
    quoted = False
    for m in _MARKS.finditer(text):
        mark = m[0]
        if mark == '"' and opened:
            quoted = not quoted
        elif mark == "{" and not quoted:
            opened.append(m.start())
        elif mark == "}" and not quoted and opened:
            start = opened.pop()
            while found and found[-1][0] > start:
                found.pop()
            found.append((start, m.end()))
    return (text[a:b] for a, b in found)


def parse(reply: str | None, required: Iterable[str] = (), rules: Mapping[str, Sequence] | None = None, nested: bool = False) -> tuple[str | None, str | None, str | None, list[str]]:
    """(data as JSON, error, error type, messages) of one reply.

    First the fenced block, or else the whole reply, is parsed; complete data with values that aren't allowed end the
    search. Otherwise the first candidate that is complete and allowed is taken. Candidates are the shortest ``{...}``, which cut an
    object that holds another one short; with ``nested`` those whose braces match come after them.
    """
    rules, required = rules or {}, list(required)
    if not reply:
        return None, "empty_ai_response", "content_error", []
    text = reply.strip()
    block = re.search(FENCE, text)
    data = _load(block[1].strip() if block else text)
    complete = lambda d: all(f in d for f in required)
    if data is not None and complete(data):
        if errors := value_errors(data, rules):
            return None, "invalid_field_values", "content_error", errors
        return json.dumps(data, ensure_ascii=False, separators=(",", ":")), None, None, []
    for candidate in chain((m[1] for m in re.finditer(OBJECT, text)), balanced_objects(text) if nested else ()):
        data = _load(candidate)
        if data is not None and complete(data) and not value_errors(data, rules):
            return json.dumps(data, ensure_ascii=False, separators=(",", ":")), None, None, []
    return None, "invalid_or_missing_json", "content_error", []


def parse_reply(reply: Column, required: Iterable[str] = (), rules: Mapping[str, Sequence] | None = None, nested: bool = False) -> Column:
    """``parse`` as a struct column."""
    required, rules = list(required), dict(rules or {})

    @F.pandas_udf(PARSED)
    def run(replies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(r, required, rules, nested) for r in replies], columns=["data_json", "error", "error_type", "validation_errors"])

    return run(reply)
