"""Tables behind REST services: record tables (pages of records) and sheets (ranges of cells).

The service is reached through a transport, an importable ``module:function(options) -> callable(method, path, body)
-> dict`` named in the options, so that tests and other services bring their own. Retries, page loops, and halving
of requests that are too large are the same for all.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tablemill.sources.xlsx import letters

Call = Callable[[str, str, Mapping | None], Mapping]
PAGE, WRITE_BATCH, SHEET_ROWS, MOST_TRIES = 500, 1000, 5000, 5


class TooLarge(Exception):
    """The request or its answer is over the service's limit."""


class Busy(Exception):
    """Rate limit or server error; ``after`` says how long to wait, if known."""

    def __init__(self, after: float | None = None):
        super().__init__(after)
        self.after = after


class Expired(Exception):
    """The access token must be fetched again."""


def patient(call: Call, renew: Callable[[], None] | None = None, tries: int = MOST_TRIES, sleep: Callable[[float], None] = time.sleep) -> Call:
    """The call, tried again: after the time asked for or 1, 2, 4.. seconds when busy, at once with a new token when expired."""

    def run(method: str, path: str, body: Mapping | None = None) -> Mapping:
        for k in range(tries):
            try:
                return call(method, path, body)
            except Busy as e:
                if k == tries - 1:
                    raise
                sleep(e.after if e.after is not None else 2.0**k)
            except Expired:
                if renew is None or k == tries - 1:
                    raise
                renew()
        raise RuntimeError("not tried")

    return run


def in_halves(items: Sequence, send: Callable[[Sequence], Any]) -> list:
    """Send all items; what is too large is halved until it fits. A single item that doesn't fit is an error."""
    out, stack = [], [items]
    while stack:
        now = stack.pop()
        if not now:
            continue
        try:
            out.append(send(now))
        except TooLarge:
            if len(now) == 1:
                raise
            half = len(now) // 2
            stack += [now[half:], now[:half]]
    return out


def records(call: Call, app: str, table: str, page: int = PAGE) -> Iterator[tuple[str, dict]]:
    """(record id, fields) of all records, page by page."""
    token = None
    while True:
        said = call("POST", f"apps/{app}/tables/{table}/records/search", {"page_size": page, "page_token": token})
        for item in said.get("items") or []:
            yield item["record_id"], item.get("fields") or {}
        token = said.get("page_token")
        if not said.get("has_more") or not token:
            return


def cell_range(sheet: str, columns: int, first: int, last: int) -> str:
    return f"{sheet}!A{first}:{letters(columns - 1)}{last}"


def parse_range(text: str) -> tuple[str, str, int, str, int]:
    """(sheet, first column, first row, last column, last row) of ``sheet!A1:C9``."""
    import re

    m = re.fullmatch(r"(.+)!([A-Z]+)(\d+):([A-Z]+)(\d+)", text)
    if not m:
        raise ValueError(f"not a range: {text}")
    return m[1], m[2], int(m[3]), m[4], int(m[5])


def sheet_values(call: Call, spreadsheet: str, sheet: str, columns: int, first: int, last: int) -> list[list]:
    """Rows first to last of a sheet; ranges that are too large are halved."""
    rows = in_halves(range(first, last + 1), lambda r: call("GET", f"sheets/{spreadsheet}/values/{cell_range(sheet, columns, r[0], r[-1])}", None).get("values") or [])
    return [row for part in rows for row in part]


def plain(value: Any) -> str:
    """A cell of any shape as text: lists by their items' text or name, links by their text."""
    if value is None:
        return ""
    if isinstance(value, list):
        return ", ".join(str(v.get("text") or v.get("name") or v) if isinstance(v, dict) else str(v) for v in value)
    if isinstance(value, dict):
        return str(value.get("text") or value.get("link") or json.dumps(value, ensure_ascii=False))
    return str(value)


def row_ranges(rows: Sequence[int]) -> list[tuple[int, int]]:
    """Sorted row numbers as inclusive runs."""
    out: list[list[int]] = []
    for r in sorted(set(rows)):
        if out and out[-1][1] == r - 1:
            out[-1][1] = r
        else:
            out.append([r, r])
    return [(a, b) for a, b in out]


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class Service:
    def __init__(self, options: Mapping[str, str]):
        self.options = dict(options)
        self.kind = self.options["kind"]

    def call(self) -> Call:
        module, _, name = self.options["transport"].partition(":")
        return patient(getattr(importlib.import_module(module), name)(self.options))

    @property
    def place(self) -> tuple[str, str]:
        o = self.options
        return (o["app_token"], o["table_id"]) if self.kind == "bitable" else (o["spreadsheet_token"], o["sheet_id"])

    def shape(self) -> tuple[int, int]:
        """(rows, columns) of a sheet, with a wide guess where the service doesn't say."""
        said = self.call()("GET", f"sheets/{self.place[0]}/meta/{self.place[1]}", None)
        return int(said.get("rows") or 10_000), int(said.get("columns") or 100)

    def header(self) -> list[str]:
        rows = sheet_values(self.call(), *self.place, self.shape()[1], 1, 1)
        return [plain(v) for v in rows[0]] if rows else []


class RestTableSource(DataSource):
    """Options: kind (bitable or sheet), transport, app_token and table_id or spreadsheet_token and sheet_id.

    Rows have ``_row_id`` (place from 0), ``record_id`` (record tables) and text columns. Of headers that repeat the last counts.
    """

    @classmethod
    def name(cls) -> str:
        return "rest_table"

    def schema(self) -> T.StructType:
        s = Service(self.options)
        if s.kind == "bitable":
            names = [f["name"] for f in s.call()("GET", f"apps/{s.place[0]}/tables/{s.place[1]}/fields", None).get("items") or []]
            lead = [T.StructField("_row_id", T.LongType()), T.StructField("record_id", T.StringType())]
        else:
            names = list(dict.fromkeys(n for n in s.header() if n))
            lead = [T.StructField("_row_id", T.LongType())]
        return T.StructType(lead + [T.StructField(n, T.StringType()) for n in names])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return RestReader(Service(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return RestWriter(Service(self.options), schema)


class RestReader(DataSourceReader):
    def __init__(self, service: Service, schema: T.StructType):
        self.service, self.names = service, [f.name for f in schema.fields]

    def partitions(self) -> Sequence[InputPartition]:
        if self.service.kind == "bitable":
            return [Rows(0, -1)]  # a page names the next one, so pages are read one by one
        last = self.service.shape()[0]
        return [Rows(a, min(a + SHEET_ROWS - 1, last)) for a in range(2, last + 1, SHEET_ROWS)] or [Rows(2, 1)]

    def read(self, part: Rows) -> Iterator[tuple]:
        s = self.service
        if s.kind == "bitable":
            for k, (record, fields) in enumerate(records(s.call(), *s.place)):
                yield (k, record, *[plain(fields.get(n)) for n in self.names[2:]])
            return
        head = s.header()
        at = {n: k for k, n in enumerate(head)}
        if part.last >= part.first:
            for k, row in enumerate(sheet_values(s.call(), *s.place, len(head), part.first, part.last)):
                yield (part.first - 2 + k, *[plain(row[at[n]]) if at[n] < len(row) else "" for n in self.names[1:]])


class RestWriter(DataSourceWriter):
    """Updates: record tables by ``record_id``, sheets by ``_row_id``, in runs of neighbouring rows of each column.

    Writing the same again is harmless, so tasks may be run again; only records without an id, which are created, may then come twice.
    """

    def __init__(self, service: Service, schema: T.StructType):
        self.service, self.names = service, [f.name for f in schema.fields]
        self.key = "record_id" if service.kind == "bitable" else "_row_id"
        if self.key not in self.names:
            raise ValueError(f"results need {self.key}")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        call, batch = self.service.call(), []
        for row in rows:
            batch.append(dict(zip(self.names, row, strict=True)))
            if len(batch) == WRITE_BATCH:
                self._send(call, batch)
                batch = []
        self._send(call, batch)
        return WriterCommitMessage()

    def _send(self, call: Call, batch: list[dict]) -> None:
        if not batch:
            return
        a, b = self.service.place
        names = [n for n in self.names if n not in ("record_id", "_row_id")]
        if self.service.kind == "bitable":
            fields = lambda r: {n: r[n] for n in names if r[n] is not None}
            known = [{"record_id": r["record_id"], "fields": fields(r)} for r in batch if r["record_id"] is not None]
            new = [{"fields": fields(r)} for r in batch if r["record_id"] is None]
            for what, rows in (("update", known), ("create", new)):
                in_halves(rows, lambda part, w=what: call("POST", f"apps/{a}/tables/{b}/records/batch_{w}", {"records": list(part)}))
            return
        head = {n: k for k, n in enumerate(self.service.header())}
        for n in names:
            column = letters(head[n])
            values = {r["_row_id"] + 2: r[n] for r in batch if r[n] is not None}
            for first, last in row_ranges(list(values)):
                in_halves(range(first, last + 1), lambda r, c=column, v=values: call("PUT", f"sheets/{a}/values", {"range": f"{b}!{c}{r[0]}:{c}{r[-1]}", "values": [[v[i]] for i in r]}))
