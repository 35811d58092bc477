"""A log of replies that a task keeps while it runs, so that a task that is tried again doesn't call again.

Spark keeps what a task has made only once the task ends. Each task of a map stage writes its replies, in segments of a few, to its
own folder of the log; a later try of the same task reads that folder first. Segments are never changed, so any store that
Arrow can write to will do. A reply is found by the row's id and a digest of what was asked, so it isn't used for another prompt.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Mapping, Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it, of a uri or an absolute path."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def key_of(ids: Sequence, row: Mapping) -> str:
    """The ids and a digest of what is sent for the row."""
    plain = lambda v: v.tolist() if hasattr(v, "tolist") else v  # noqa: E731  arrays and numbers as Arrow gives them
    asked = json.dumps([plain(row.get(c)) for c in ("prompt", "system_prompt", "model", "temperature")], default=str)
    return json.dumps([[plain(v) for v in ids], hashlib.md5(asked.encode()).hexdigest()], default=str)  # noqa: S324  not for secrecy


class Journal:
    """One task's part of the log: what earlier tries have written, and a segment for every ``rows`` replies or ``seconds``."""

    def __init__(self, path: str, part: int, rows: int = 64, seconds: float = 5.0):
        self.store, at = store_of(path)
        self.folder, self.rows, self.seconds = f"{at.rstrip('/')}/part={part:06d}", rows, seconds
        self.store.create_dir(self.folder, recursive=True)
        self.waiting: list[str] = []
        self.since = time.monotonic()
        self.known: dict[str, tuple] = {}
        for info in self.store.get_file_info(fs.FileSelector(self.folder)):
            if info.path.endswith(".jsonl"):
                with self.store.open_input_stream(info.path) as f:
                    for line in f.read().decode().splitlines():
                        said = json.loads(line)
                        self.known[said["key"]] = tuple(said["out"])

    def add(self, key: str, out: tuple) -> None:
        self.waiting.append(json.dumps({"key": key, "out": out}))
        if len(self.waiting) >= self.rows or time.monotonic() - self.since > self.seconds:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            # a segment is complete once it has its name
            name = f"{self.folder}/{uuid.uuid4().hex}"
            with self.store.open_output_stream(f"{name}.tmp") as f:
                f.write(("\n".join(self.waiting) + "\n").encode())
            self.store.move(f"{name}.tmp", f"{name}.jsonl")
        self.waiting, self.since = [], time.monotonic()


def logged(spark: SparkSession, path: str) -> DataFrame:
    """(key, reply_json, _error, _error_type, attempts, errors) of all that the log holds, once for each key."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").schema("value string").text(path)
    said = lines.select(F.get_json_object("value", "$.key").alias("key"), F.from_json(F.get_json_object("value", "$.out"), "array<string>").alias("_out"))
    named = said.select("key", *[F.col("_out")[k].alias(c) for k, c in enumerate(("reply_json", "_error", "_error_type"))], F.col("_out")[3].cast("int").alias("attempts"), F.from_json(F.col("_out")[4], "array<string>").alias("errors"))
    return named.dropDuplicates(["key"])
