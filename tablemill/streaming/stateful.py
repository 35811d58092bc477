"""Keyed state on streams: token buckets, backoff of models, and retry records that expire.

Rows of a key come in batches of bounded size and are put into map state by their time; each time has a timer. Timers of event
time are read in order once the watermark has passed them, so rows are taken in order without gathering a key's batch, and rows that come
out of order within the watermark's delay are put right. Retry records expire by a timer that moves with the key's last error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Retry records are dropped when a key was silent for so long.
EXPIRY_MS = 24 * 3600 * 1000
# names inside of a processor begin with a letter, as others reach it under other names
#: State with timers needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def needs_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Backoffs(StatefulProcessor):
    """Failures in a row, and the time from which on the model may be asked again, after each time at which requests ended."""

    def __init__(self, factor: float):
        self.factor = factor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ended = handle.getMapState("ended", "ms bigint", "failed bigint, good boolean")
        self.state = handle.getValueState("state", "fails bigint, until double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for ms, part in batch.groupby("ms"):
                at = (int(ms),)
                failed, good = self.ended.getValue(at) if self.ended.containsKey(at) else (0, False)
                self.ended.updateValue(at, (failed + int((~part["good"]).sum()), bool(good or part["good"].any())))
                self.handle.registerTimer(int(ms))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        if not self.ended.containsKey((ms,)):
            return
        failed, good = self.ended.getValue((ms,))
        self.ended.removeKey((ms,))
        fails, until = self.state.get() if self.state.exists() else (0, 0.0)
        # what failed at the time of a success was before it
        fails = 0 if good else fails + failed
        until = 0.0 if good else ms / 1000 + (2 * fails if fails <= 3 else min(6 + self.factor ** (fails - 3), 60))
        self.state.update((int(fails), float(until)))
        yield pd.DataFrame({"key": [key[0]], "ts": [ms / 1000], "fails": [int(fails)], "next_ts": [float(until)]})

    def close(self) -> None:
        pass


class Buckets(StatefulProcessor):
    """How many of the requests of each time find a token."""

    def __init__(self, rps: float, most: float):
        self.rps, self.most = rps, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getMapState("asked", "ms bigint", "n bigint")
        self.state = handle.getValueState("state", "tokens double, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for ms, n in batch["ms"].value_counts().items():
                at = (int(ms),)
                self.asked.updateValue(at, ((self.asked.getValue(at)[0] if self.asked.containsKey(at) else 0) + int(n),))
                self.handle.registerTimer(int(ms))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        if not self.asked.containsKey((ms,)):
            return
        n = self.asked.getValue((ms,))[0]
        self.asked.removeKey((ms,))
        tokens, last = self.state.get() if self.state.exists() else (self.most, ms / 1000)
        tokens = min(self.most, tokens + max(0.0, ms / 1000 - last) * self.rps)
        admitted = min(n, int(tokens))
        self.state.update((float(tokens - admitted), float(max(last, ms / 1000))))
        yield pd.DataFrame({"key": [key[0]], "ts": [ms / 1000], "n": [n], "n_admitted": [admitted]})

    def close(self) -> None:
        pass


class Records(StatefulProcessor):
    """Errors of a task by class so far; a task that is silent for long enough starts anew."""

    kinds = ("api_error", "content_error", "system_error")

    def __init__(self, expiry_ms: int):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("errors", "a bigint, c bigint, s bigint, last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        *counts, last = self.state.get() if self.state.exists() else (0, 0, 0, None)
        before = last
        for batch in rows:
            counts = [n + int((batch["kind"] == k).sum()) for n, k in zip(counts, self.kinds, strict=True)]
            newest = int(batch["ms"].max())
            last = newest if last is None else max(last, newest)
        if before != last:
            if before is not None:
                self.handle.deleteTimer(before + self.expiry_ms)
            self.handle.registerTimer(last + self.expiry_ms)
        self.state.update((*counts, last))
        yield pd.DataFrame({"key": [key[0]], **{k: [n] for k, n in zip(self.kinds, counts, strict=True)}, "last_ts": [last / 1000]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def _timed(df: DataFrame, key: str, ts: str, delay: str, **more: Column) -> DataFrame:
    ms = (F.col(ts) * 1000).cast("bigint")
    rows = df.select(F.col(key).alias("key"), ms.alias("ms"), F.timestamp_millis(ms).alias("at"), *[c.alias(n) for n, c in more.items()])
    return rows.withWatermark("at", delay)


def admitted(requests: DataFrame, key: str, ts: str, rps: float, capacity: float | None = None, delay: str = "10 seconds") -> DataFrame:
    """(key, ts, n, n_admitted) for a stream of requests: of the n at a time (in seconds, to the millisecond), how many found a token.

    A time is settled once the watermark, ``delay`` behind the latest request, has passed it.
    """
    needs_store(requests.sparkSession)
    kind = requests.schema[key].dataType.simpleString()
    return _timed(requests, key, ts, delay).groupBy("key").transformWithStateInPandas(Buckets(rps, 2 * rps if capacity is None else capacity), f"key {kind}, ts double, n bigint, n_admitted bigint", "Append", "EventTime").withColumnRenamed("key", key)


def backoffs(outcomes: DataFrame, key: str, ts: str, ok: str, factor: float = 2.0, delay: str = "10 seconds") -> DataFrame:
    """(key, ts, fails, next_ts) for a stream of request outcomes: after each time, failures in a row and when the model may be asked again.

    A time is settled once the watermark, ``delay`` behind the latest outcome, has passed it.
    """
    needs_store(outcomes.sparkSession)
    kind = outcomes.schema[key].dataType.simpleString()
    return _timed(outcomes, key, ts, delay, good=F.col(ok)).groupBy("key").transformWithStateInPandas(Backoffs(factor), f"key {kind}, ts double, fails bigint, next_ts double", "Append", "EventTime").withColumnRenamed("key", key)


def retry_records(errors: DataFrame, key: str, kind: str, ts: str, expiry_ms: int = EXPIRY_MS, delay: str = "10 seconds") -> DataFrame:
    """(key, api_error, content_error, system_error, last_ts) after each batch of errors: a task's errors by class so far.

    A task whose last error is ``expiry_ms`` behind the watermark starts anew.
    """
    needs_store(errors.sparkSession)
    name = errors.schema[key].dataType.simpleString()
    rows = _timed(errors, key, ts, delay, kind=F.col(kind))
    return rows.groupBy("key").transformWithStateInPandas(Records(expiry_ms), f"key {name}, api_error bigint, content_error bigint, system_error bigint, last_ts double", "Update", "EventTime").withColumnRenamed("key", key)
