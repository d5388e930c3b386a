"""Progress, time to go, retries, and when a status line is due."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def progress(copied: Column, estimate: Column, delta: Column, done: Column) -> Column:
    """Percent copied; once the copy is done, what was copied is the estimate."""
    whole = F.when(done, copied).otherwise(estimate + delta)
    return F.when(whole == 0, F.lit(100.0)).otherwise(F.lit(100.0) * copied / whole)


def eta_seconds(percent: Column, copied: Column, estimate: Column, rate: Column, elapsed: Column) -> Column:
    """0 when all is copied, null below 0.1 %; else what is left at the last second's rate, or in proportion to the time so far."""
    left = estimate - copied
    return F.when(percent >= 100, F.lit(0.0)).when(percent < 0.1, F.lit(None).cast("double")).when(rate > 0, left / rate).otherwise(elapsed * left / copied)


def status_due(elapsed: int, eta: float | None, since_interest: float | None = None) -> bool:
    """Is a status line due in this second?  Every second in the first minute and the last one, every 30 in between.

    Every 5 in the first and last three minutes, and for a minute after a point of interest (a command, a cut-over attempt).
    """
    if elapsed <= 60 or (eta is not None and eta <= 60):
        return True
    often = elapsed <= 180 or (eta is not None and eta <= 180) or (since_interest is not None and since_interest <= 60)
    return elapsed % (5 if often else 30) == 0


def pretty(seconds: float) -> str:
    s = int(seconds)
    parts = [(s // 3600, "h"), (s % 3600 // 60, "m"), (s % 60, "s")]
    while len(parts) > 1 and parts[0][0] == 0:
        parts.pop(0)
    return "".join(f"{n}{u}" for n, u in parts)


class Fatal(RuntimeError):
    """An error that no retry mends."""


def retry(operation: Callable[[], object], attempts: int, longest: float = 0, sleep: Callable[[float], None] = time.sleep, failed: Callable[[Exception], None] = lambda e: None):
    """Run until it succeeds: a second apart, or 2^n seconds up to ``longest``.  Fatal errors end it at once; failed: told of each other one."""
    for k in range(attempts):
        if k:
            sleep(min(longest, max(1, 2 ** (k - 1))) if longest else 1)
        try:
            return operation()
        except Fatal:
            raise
        except Exception as e:
            if k == attempts - 1:
                raise
            failed(e)
    return None
