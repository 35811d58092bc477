"""A run's progress, as a JSON file that is replaced whole."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

STALE_SECONDS = 30


def report(path: str, total: int, done: int, errors: int = 0, part: str = "", now: float | None = None) -> None:
    """Written beside the file and moved over it, so that a reader never sees half of it."""
    beside = Path(f"{path}.tmp")
    beside.write_text(json.dumps({"total": total, "processed": done, "active": max(0, total - done), "errors": errors, "shard": part, "ts": time.time() if now is None else now}))
    os.replace(beside, path)


def read(path: str, now: float | None = None) -> dict | None:
    """The last report with ``percent`` and ``stale``, or None where there is none or it can't be read."""
    try:
        said = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return None
    said["percent"] = 100.0 if said["total"] <= 0 else said["processed"] / said["total"] * 100
    said["stale"] = (time.time() if now is None else now) - said["ts"] > STALE_SECONDS
    return said


def clear(path: str) -> None:
    Path(path).unlink(missing_ok=True)
