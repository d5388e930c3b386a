"""Measurements of a run: gauges, counts and durations, kept as rows and sent to any sinks."""

from __future__ import annotations

import socket
import time
from collections.abc import Callable
from contextlib import contextmanager


#: Fixed names of a run's metrics, below the prefix.
NAMES = (
    "row_copy.rows_copied", "row_copy.rows_estimate", "dml.events_applied", "binlog.backlog_size", "binlog.backlog_capacity", "binlog.backlog_utilization",
    "lag.replication_seconds", "lag.heartbeat_seconds", "throttle.active", "throttle.duration_milliseconds", "throttle.events_total",
    "cut_over.phase_duration_milliseconds", "cut_over.attempts_total", "cut_over.total_duration_milliseconds",
    "sleep.duration_milliseconds", "sleep.total_milliseconds", "query.duration_milliseconds",
)


class Metrics:
    """Measurements by name, with tags of the run and of each; rows: (time, kind, name, value, tags)."""

    def __init__(self, prefix: str = "shiftwell", tags: dict[str, str] | None = None):
        self.prefix, self.tags, self.rows, self.sinks = prefix, tags or {}, [], []

    def add_sink(self, sink: Callable[[str, str, float, dict], None]) -> None:
        self.sinks.append(sink)

    def _put(self, kind: str, name: str, value: float, tags: dict) -> None:
        own = self.tags | {k: str(v) for k, v in tags.items()}
        self.rows.append((time.time(), kind, f"{self.prefix}.{name}", float(value), own))
        for s in self.sinks:
            s(kind, f"{self.prefix}.{name}", float(value), own)

    def gauge(self, name: str, value: float, **tags) -> None:
        self._put("gauge", name, value, tags)

    def count(self, name: str, n: float = 1, **tags) -> None:
        self._put("count", name, n, tags)

    def histogram(self, name: str, value: float, **tags) -> None:
        self._put("histogram", name, value, tags)

    @contextmanager
    def timed(self, name: str, **tags):
        """Milliseconds of a block, with its outcome."""
        t, outcome = time.monotonic(), "error"
        try:
            yield
            outcome = "success"
        finally:
            self._put("histogram", name, 1000 * (time.monotonic() - t), tags | {"outcome": outcome})


def utilization(size: float, capacity: float) -> float:
    """Share of a backlog that is filled, from 0 to 1."""
    return min(1.0, max(0.0, size / capacity)) if capacity > 0 else 0.0


def statsd_sink(host: str, port: int):
    """A sink in the StatsD line format over UDP; lost packets are nobody's error."""
    sock = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    letters = {"gauge": "g", "count": "c", "histogram": "h"}

    def send(kind: str, name: str, value: float, tags: dict) -> None:
        tail = "|#" + ",".join(f"{k}:{v}" for k, v in tags.items()) if tags else ""
        sock.sendto(f"{name}:{value:g}|{letters[kind]}{tail}".encode(), (host, port))

    return send
