"""Calling a model for every row: bounded concurrency, retries by class of error, and a breaker, inside each task.

A client is any object with ``call(messages, model, temperature) -> str``; the factory that makes it is sent to the
tasks. Errors say their class by raising ApiError or ContentError; anything else is a system error.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from threading import Lock
from typing import Protocol

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.reply import parse
from tablemill.operators.journal import Journal, key_of


class ApiError(Exception):
    """The service failed; it may work later."""


class ContentError(Exception):
    """The reply can't be used."""


class ModelClient(Protocol):
    def call(self, messages: list[dict[str, str]], model: str, temperature: float) -> str: ...


@dataclass(frozen=True)
class Retry:
    """Limits are the retries that follow the first try, by class of error (1 for one that isn't listed)."""

    limits: Mapping[str, int] = field(default_factory=lambda: {"api_error": 3, "content_error": 1, "system_error": 2})
    pause: float = 2.0
    window: float = 2.0


def decision(kind: Column, retries: Column, since_pause: Column, limits: Mapping[str, int], window: float) -> Column:
    """fail, pause or retry, and whether the row is to be read again, as a struct (action, reload)."""
    limit = F.lit(1)
    for k, n in limits.items():
        limit = F.when(kind == k, F.lit(n)).otherwise(limit)
    action = F.when(retries >= limit, "fail").when((kind == "api_error") & (since_pause > window), "pause").otherwise("retry")
    return F.struct(action.alias("action"), (F.when(retries >= limit, False).otherwise(kind != "content_error")).alias("reload"))


def decide(kind: str, retries: int, since_pause: float, retry: Retry) -> tuple[str, bool]:
    """The same as ``decision`` for one row."""
    if retries >= retry.limits.get(kind, 1):
        return "fail", False
    return "pause" if kind == "api_error" and since_pause > retry.window else "retry", kind != "content_error"


class Breaker:
    """A pause that all calls of a task wait for. One pause at a time, and none within the window after it."""

    def __init__(self, retry: Retry, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.retry, self.clock, self.sleep = retry, clock, sleep
        self.lock, self.ended, self.until = Lock(), float("-inf"), float("-inf")

    def failed(self, kind: str = "api_error", retries: int = 0) -> tuple[str, bool]:
        """What is to be done about a failed call; a pause begins at once."""
        with self.lock:
            now = self.clock()
            action, again = decide(kind, retries, now - self.ended if now >= self.until else 0.0, self.retry)
            if action == "pause":
                self.until = self.ended = now + self.retry.pause
            return action, again

    def wait(self) -> None:
        with self.lock:
            left = self.until - self.clock()
        if left > 0:
            self.sleep(left)


class Rate:
    """At most so many calls a second started by this task."""

    def __init__(self, rps: float | None):
        self.gap, self.next, self.lock = (1 / rps if rps else 0.0), 0.0, Lock()

    def wait(self) -> None:
        if not self.gap:
            return
        with self.lock:
            now = time.monotonic()
            at = max(now, self.next)
            self.next = at + self.gap
        if at > now:
            time.sleep(at - now)


OUT = "reply_json string, _error string, _error_type string, attempts int, errors array<string>"


def call_row(row: Mapping, client: ModelClient, retry: Retry, breaker: Breaker, rate: Rate, required: Sequence[str], rules: Mapping[str, Sequence], reread: Callable[[Mapping], Mapping | None] | None = None) -> tuple:
    """(reply_json, _error, _error_type, attempts, last five errors) for one row with prompt, system_prompt, model and temperature.

    Before a retry after an API or system error, ``reread`` gives the row as it is now, or None if it can't be had, which ends the tries.
    """
    tried: dict[str, int] = {}
    history: list[str] = []
    if not row["prompt"]:
        return None, "prompt_generation_failed", "system_error", 0, []
    messages = [{"role": r, "content": c} for r, c in (("system", row.get("system_prompt")), ("user", row["prompt"])) if c]
    attempts = 0
    own = row.get("required")
    fields = list(required) if own is None or len(own) == 0 else list(own)
    while True:
        attempts += 1
        breaker.wait()
        rate.wait()
        try:
            data, error, kind, said = parse(client.call(messages, row.get("model") or "auto", row.get("temperature")), fields, rules)
            if error is None:
                return data, None, None, attempts, history[-5:]
            message = "; ".join([error, *said])
        except ApiError as e:
            kind, message, error = "api_error", str(e), str(e)
        except ContentError as e:
            kind, message, error = "content_error", str(e), str(e)
        except Exception as e:  # noqa: BLE001  whatever a client raises is a system error of its row
            kind, message, error = "system_error", f"{type(e).__name__}: {e}", str(e)
        history.append(f"{kind}: {message}")
        action, again = breaker.failed(kind, tried.get(kind, 0))
        if action == "fail":
            return None, error, kind, attempts, history[-5:]
        tried[kind] = tried.get(kind, 0) + 1
        if again and reread is not None:
            try:
                now = reread(row)
            except Exception as e:  # noqa: BLE001  a source that can't be read is a system error of the row
                now, error = None, f"{type(e).__name__}: {e}"
            if now is None:
                return None, f"reload_failed: {error}", "system_error", attempts, history[-5:]
            row = {**row, **now}
            messages = [{"role": r, "content": c} for r, c in (("system", row.get("system_prompt")), ("user", row["prompt"])) if c]


def infer(
    df: DataFrame, make_client: Callable[[], ModelClient], keep: Sequence[str], required: Sequence[str] = (), rules: Mapping[str, Sequence] | None = None, retry: Retry | None = None, concurrency: int = 16, rps: float | None = None,
    make_reread: Callable[[], Callable[[Mapping], Mapping | None]] | None = None, journal: str | None = None, journal_rows: int = 64,
) -> DataFrame:
    """``keep`` columns with reply_json, _error, _error_type, attempts and errors (the last five) for every row.

    ``df`` has prompt and perhaps system_prompt, model, temperature and required. Each task keeps at most
    ``concurrency`` calls open and starts at most ``rps`` a second, so the whole job's rate is that times the tasks that
    run at once. ``make_reread`` makes, once in each task, a function from a row (``keep`` and the columns above) to those of
    its columns that have changed in the source, or None; it is asked before retries after API and system errors. Results come as they are ready. Write the result before it is used twice: a second reading would call again.

    ``journal`` names a folder that all tasks can write to: replies are logged there, ``journal_rows`` at a time, and a task that is tried
    again takes what its earlier tries have logged instead of calling. A log is of one plan over one table: its parts are the tasks' numbers.
    """
    retry, rules = retry or Retry(), dict(rules or {})
    names = [c for c in ("prompt", "system_prompt", "model", "temperature", "required") if c in df.columns]
    kept = [c for c in keep if c not in names]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields) + ", " + OUT
    out = ["reply_json", "_error", "_error_type", "attempts", "errors"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, breaker, rate = make_client(), Breaker(retry), Rate(rps)
        reread = make_reread() if make_reread else None
        log = Journal(journal, TaskContext.get().partitionId(), journal_rows) if journal else None
        open_: dict[Future, tuple] = {}

        def taken(f: Future) -> tuple:
            ids, key = open_.pop(f)
            if log:
                log.add(key, f.result())
            return (*ids, *f.result())

        def done(block: bool) -> Iterator[pd.DataFrame]:
            if open_:
                ready, _ = wait(open_, return_when=FIRST_COMPLETED) if block else wait(open_, timeout=0)
                if ready:
                    yield pd.DataFrame([taken(f) for f in ready], columns=kept + out)

        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                for row in batch.to_dict("records"):
                    ids = tuple(row[c] for c in kept)
                    key = key_of(ids, row) if log else ""
                    if log and key in log.known:
                        yield pd.DataFrame([(*ids, *log.known[key])], columns=kept + out)
                        continue
                    while len(open_) >= concurrency:
                        yield from done(block=True)
                    open_[pool.submit(call_row, row, client, retry, breaker, rate, required, rules, reread)] = (ids, key)
                yield from done(block=False)
            while open_:
                yield from done(block=True)
        if log:
            log.flush()

    return df.select(*kept, *names).mapInPandas(run, schema)


def extracted(replies: DataFrame, id_col: str, outputs: Sequence[str]) -> DataFrame:
    """Inferred rows as results: an output column for each alias from the reply's data, nested values as JSON."""

    @F.pandas_udf("map<string,string>")
    def flat(replies: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            return {k: v if isinstance(v, str) else None if v is None else json.dumps(v, ensure_ascii=False) for k, v in json.loads(text).items()}

        return replies.map(one)

    return replies.select(id_col, flat("reply_json").alias("_data"), "_error", "_error_type").select(id_col, *[F.try_element_at("_data", F.lit(a)).alias(a) for a in outputs], "_error", "_error_type")


class FakeClient:
    """Deterministic replies for tests and dry runs: ``answer(messages)`` may raise."""

    def __init__(self, answer: Callable[[list[dict[str, str]]], str], seconds: float = 0.0):
        self.answer, self.seconds = answer, seconds

    def call(self, messages: list[dict[str, str]], model: str, temperature: float) -> str:
        if self.seconds:
            time.sleep(self.seconds)
        return self.answer(messages)


class HttpClient:
    """An OpenAI-compatible chat endpoint, over the standard library. One per task."""

    def __init__(self, url: str, headers: Mapping[str, str] | None = None, timeout: float = 300, json_mode: bool = True):
        self.url, self.timeout, self.json_mode = url, timeout, json_mode
        self.headers = {"Content-Type": "application/json", **(headers or {})}

    def call(self, messages: list[dict[str, str]], model: str, temperature: float) -> str:
        import urllib.error
        import urllib.request

        body = {"model": model, "messages": messages, "temperature": temperature} | ({"response_format": {"type": "json_object"}} if self.json_mode else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), self.headers), timeout=self.timeout) as r:  # noqa: S310
                said = json.load(r)
        except (urllib.error.URLError, TimeoutError, OSError) as e:
            raise ApiError(str(e)) from e
        try:
            return said["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as e:
            raise ApiError(f"malformed response: {e!r}") from e
