"""Back-pressure: why a migration should wait now."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@dataclass
class Metrics:
    """What the checks look at; times are seconds, lags milliseconds."""

    hibernate_until: float | None = None
    user_command: bool = False
    flag_files: tuple[str, ...] = ()
    load: dict[str, int] = field(default_factory=dict)
    max_load: dict[str, int] = field(default_factory=dict)
    critical_load: dict[str, int] = field(default_factory=dict)
    query_result: int = 0
    http_status: int = 200
    lag_millis: int = 0
    lag_error: str | None = None
    max_lag_millis: int = 1500
    replica: str | None = None
    replica_lag_millis: int = 0
    replica_error: str | None = None


class CriticalLoad(RuntimeError):
    """The load is such that the migration must end."""


def general_reason(m: Metrics) -> str | None:
    for k, limit in m.critical_load.items():
        if m.load.get(k, 0) >= limit:
            raise CriticalLoad(f"critical-load {k}={m.load[k]} >= {limit}")
    if m.user_command:
        return "commanded by user"
    for f in m.flag_files:
        if Path(f).exists():
            return "flag-file"
    for k, limit in sorted(m.max_load.items()):
        if m.load.get(k, 0) >= limit:
            return f"max-load {k}={m.load[k]} >= {limit}"
    if m.query_result > 0:
        return "throttle-query"
    return None


def reason(m: Metrics, now: float | None = None) -> str | None:
    """The first check that asks to wait: hibernation, general, HTTP, lag, control replicas."""
    if m.hibernate_until is not None and (time.time() if now is None else now) < m.hibernate_until:
        return "critical-load-hibernate"
    if why := general_reason(m):
        return why
    if m.http_status != 200:
        return f"http={m.http_status}"
    if m.lag_error:
        return f"lag error: {m.lag_error}"
    if m.lag_millis > m.max_lag_millis:
        return f"lag={m.lag_millis / 1000:.3f}s"
    if m.replica_error:
        return f"{m.replica} replica-lag error: {m.replica_error}"
    if m.replica_lag_millis > m.max_lag_millis:
        return f"{m.replica} replica-lag={m.replica_lag_millis / 1000:.3f}s"
    return None


def reason_column() -> Column:
    """The order of the checks over rows of metrics (hibernating, user_command, flag_file, load, max_load, query_result, http_status, lag_millis, replica_lag_millis, max_lag_millis)."""
    return (
        F.when(F.col("hibernating"), "hibernate").when(F.col("user_command"), "user").when(F.col("flag_file"), "flag-file").when(F.col("load") >= F.col("max_load"), "max-load")
        .when(F.col("query_result") > 0, "query").when(F.col("http_status") != 200, "http").when(F.col("lag_millis") > F.col("max_lag_millis"), "lag")
        .when(F.col("replica_lag_millis") > F.col("max_lag_millis"), "replica-lag").otherwise("none")
    )


def query_result(spark: SparkSession, sql: str) -> int:
    """The number that a throttle query returns; above zero means wait."""
    row = spark.sql(sql).first()
    return int(row[0] or 0) if row else 0


def http_status(url: str, timeout: float = 1.0, ignore_errors: bool = False) -> int:
    """Status of a HEAD request; -1 if it fails, unless errors are to be ignored."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as r:
            return r.status
    except urllib.error.HTTPError as e:
        return e.code
    except OSError:
        return 200 if ignore_errors else -1


class Gate:
    """Blocks between jobs while a reason holds; silent in the critical part of a cut-over."""

    def __init__(self, collect: Callable[[], Metrics], poll: float = 0.25, sleep: Callable[[float], None] = time.sleep):
        self.collect, self.poll, self.sleep = collect, poll, sleep
        self.suppressed = False
        self.last: str | None = None

    def __call__(self) -> None:
        while not self.suppressed:
            self.last = reason(self.collect())
            if self.last is None:
                return
            self.sleep(self.poll)
