"""A model client over several models: weighted choice, rate limits, backoff of failing ones, and failover within a request."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from threading import Lock

from tablemill.operators.infer import ApiError, ModelClient

MOST_ATTEMPTS = 3
ALPHA = 0.1
FREE = ("auto", "any", "default", "*", "")


def backoff(fails: int, factor: float = 2.0) -> float:
    return 0.0 if fails <= 0 else 2.0 * fails if fails <= 3 else min(6 + factor ** (fails - 3), 60.0)


@dataclass
class Model:
    """A configured model and what its task has seen of it."""

    id: str
    client: ModelClient
    weight: float = 1.0
    name: str | None = None
    model: str | None = None
    safe_rps: float | None = None
    temperature: float = 0.7
    fails: int = 0
    free_at: float = 0.0
    ok: int = 0
    errors: int = 0
    seconds: float | None = None
    tokens: float = field(default=0.0, init=False)
    filled: float | None = field(default=None, init=False)

    def __post_init__(self):
        self.rps = self.safe_rps or max(0.5, min(self.weight / 10, 10.0))
        self.tokens = 2 * self.rps

    def refill(self, now: float) -> None:
        if self.filled is not None:
            self.tokens = min(2 * self.rps, self.tokens + (now - self.filled) * self.rps)
        self.filled = now


class FailoverClient:
    """Each request tries the model asked for, if it can be used, or one by weight, and then others, three at most.

    State is a task's own: the job's rate is the models' rate times the tasks that run at once.
    """

    def __init__(self, models: Sequence[Model], seed: int = 0, clock: Callable[[], float] = time.monotonic):
        if not models:
            raise ValueError("no models")
        self.models, self.clock, self.lock, self.random = list(models), clock, Lock(), random.Random(seed)
        self.names: dict[str, Model] = {}
        for m in self.models:
            self.names |= {n: m for n in (m.id, m.model, m.name) if n}

    def _take(self, asked: str, tried: set[str]) -> Model | None:
        """A usable model with a token, which is taken; models refused for their rate count as tried."""
        with self.lock:
            now = self.clock()
            usable = []
            for m in self.models:
                m.refill(now)
                if m.weight > 0 and m.id not in tried and now >= m.free_at and m.tokens >= 1:
                    usable.append(m)
            if not usable:
                return None
            wanted = self.names.get(asked) if asked.lower() not in FREE else None
            m = wanted if wanted in usable else self.random.choices(usable, [x.weight for x in usable])[0]
            m.tokens -= 1
            return m

    def _done(self, m: Model, seconds: float, ok: bool) -> None:
        with self.lock:
            m.seconds = seconds if m.seconds is None else (1 - ALPHA) * m.seconds + ALPHA * seconds
            if ok:
                m.ok, m.fails, m.free_at = m.ok + 1, 0, 0.0
            else:
                m.errors, m.fails = m.errors + 1, m.fails + 1
                m.free_at = self.clock() + backoff(m.fails)

    def call(self, messages: list[dict[str, str]], model: str, temperature: float | None) -> str:
        tried: set[str] = set()
        last: Exception | None = None
        for _ in range(min(len(self.models), MOST_ATTEMPTS)):
            m = self._take(model or "", tried)
            if m is None:
                break
            tried.add(m.id)
            began = self.clock()
            try:
                said = m.client.call(messages, m.model or m.id, m.temperature if temperature is None else temperature)
            except Exception as e:  # noqa: BLE001  whatever fails, another model may do
                last = e
                self._done(m, self.clock() - began, ok=False)
            else:
                self._done(m, self.clock() - began, ok=True)
                return said
        raise ApiError(f"no model could answer: {last}" if last else "no model is available")

    def stats(self) -> list[Mapping]:
        return [{"id": m.id, "ok": m.ok, "errors": m.errors, "rate": m.ok / (m.ok + m.errors) if m.ok + m.errors else 1.0, "seconds": m.seconds, "fails": m.fails} for m in self.models]
