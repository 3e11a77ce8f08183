"""The live frontier: a state machine per host as a streaming operator, with its transitions as plain functions.

Commands arrive as rows (host, kind, url, priority, ord, at, attempt, retryable, retry_after); leases leave. A host
serves one URL at a time and waits ``delay`` seconds between leases; failed URLs come back after a backoff that doubles
up to a cap and never before a server's Retry-After; an answer whose attempt number is not the current one is stale
and is dropped. The batch twin for a crawl without delays is brookmill.operators.frontier.fair_order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COMMANDS = "host string, kind string, url string, priority int, ord bigint, at double, attempt int, retryable boolean, retry_after double"
LEASES = "host string, url string, attempt int, leased_at double, outcome string"
STATE = "state string"


@dataclass
class Entry:
    url: str
    priority: int
    ord: int
    ready_at: float
    state: str = "queued"
    attempts: int = 0
    reason: str = ""


@dataclass
class Host:
    """All URLs of one host. States: queued, retry_wait, in_flight, terminal."""

    delay: float = 1.0
    base: float = 1.0
    cap: float = 120.0
    most_attempts: int = 3
    next_allowed_at: float = 0.0
    entries: dict[str, Entry] = field(default_factory=dict)

    def admit(self, url: str, priority: int, ord: int, at: float) -> bool:
        """A new URL is queued; a known one that waits may become more urgent or ready earlier."""
        e = self.entries.get(url)
        if e is None:
            self.entries[url] = Entry(url, priority, ord, at)
            return True
        if e.state in ("queued", "retry_wait"):
            e.priority = max(e.priority, priority)
            e.ready_at = min(e.ready_at, at) if e.state == "queued" else e.ready_at
        return False

    def claim(self, now: float) -> Entry | None:
        if now < self.next_allowed_at or any(e.state == "in_flight" for e in self.entries.values()):
            return None
        ready = [e for e in self.entries.values() if e.state in ("queued", "retry_wait") and e.ready_at <= now]
        if not ready:
            return None
        e = min(ready, key=lambda e: (-e.priority, e.ord))
        e.state, e.attempts = "in_flight", e.attempts + 1
        self.next_allowed_at = now + self.delay
        return e

    def resolve(self, url: str, attempt: int) -> Entry | None:
        """The leased entry, or None for a stale answer."""
        e = self.entries.get(url)
        return e if e and e.state == "in_flight" and e.attempts == attempt else None

    def succeed(self, url: str, attempt: int) -> str:
        e = self.resolve(url, attempt)
        if e is None:
            return "stale"
        e.state, e.reason = "terminal", "succeeded"
        return "succeeded"

    def fail(self, url: str, attempt: int, now: float, retryable: bool, retry_after: float | None = None) -> str:
        e = self.resolve(url, attempt)
        if e is None:
            return "stale"
        if not retryable or e.attempts >= self.most_attempts:
            e.state, e.reason = "terminal", "retry_exhausted" if retryable else "permanent_failure"
            return e.reason
        wait = max(min(self.cap, self.base * 2 ** (e.attempts - 1)), min(self.cap, retry_after or 0.0))
        e.state, e.ready_at = "retry_wait", now + wait
        self.next_allowed_at = max(self.next_allowed_at, now + min(self.cap, retry_after or 0.0))
        return "retry"

    def terminate(self, reason: str) -> int:
        waiting = [e for e in self.entries.values() if e.state in ("queued", "retry_wait")]
        for e in waiting:
            e.state, e.reason = "terminal", reason
        return len(waiting)

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def load(cls, text: str) -> "Host":
        raw = json.loads(text)
        raw["entries"] = {k: Entry(**v) for k, v in raw["entries"].items()}
        return cls(**raw)


def apply(host: Host, commands: pd.DataFrame) -> list[tuple[str, int, float, str]]:
    """Runs commands in the order of time, claiming whenever the host may; (url, attempt, at, outcome) of each event."""
    out = []
    for c in commands.sort_values(["at", "ord"]).itertuples():
        if c.kind == "admit":
            out.append((c.url, 0, c.at, "admitted" if host.admit(c.url, int(c.priority), int(c.ord), c.at) else "duplicate"))
        elif c.kind == "succeed":
            out.append((c.url, int(c.attempt), c.at, host.succeed(c.url, int(c.attempt))))
        elif c.kind == "fail":
            after = None if pd.isna(c.retry_after) else float(c.retry_after)
            out.append((c.url, int(c.attempt), c.at, host.fail(c.url, int(c.attempt), c.at, bool(c.retryable), after)))
        elif c.kind == "cancel":
            host.terminate("cancelled")
        if c.kind in ("tick", "admit", "succeed", "fail") and (e := host.claim(c.at)):
            out.append((e.url, e.attempts, c.at, "leased"))
    return out


def frontier(commands: DataFrame, **limits: float) -> DataFrame:
    """The stream of leases and outcomes over a stream (or batch) of commands, keyed by host."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        host = Host.load(state.get[0]) if state.exists else Host(**limits)
        rows = [(key[0], *r) for b in batches for r in apply(host, b)]
        state.update((host.dump(),))
        yield pd.DataFrame(rows, columns=["host", "url", "attempt", "leased_at", "outcome"])

    return commands.groupBy("host").applyInPandasWithState(step, LEASES, STATE, "append", GroupStateTimeout.NoTimeout)


def telemetry(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of an event stream per type in tumbling windows, with late rows dropped behind the watermark."""
    from pyspark.sql import functions as F

    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
