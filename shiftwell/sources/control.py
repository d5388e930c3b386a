"""The control table: heartbeats, states and throttle notes, as an append-only log of upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import TableStore

#: Fixed ids of hints that are overwritten; others are appended from 256 on (fixed values).
FIXED_IDS = {"heartbeat": 1, "state": 2, "throttle": 3}
FIRST_FREE_ID = 256


def hint_id(hint: str, last_id: int = 0) -> int:
    return FIXED_IDS.get(hint, max(FIRST_FREE_ID, last_id + 1))


class ControlTable:
    """The control table as a store: each write is one more row (seq, ord, id, hint, value); of a hint with a fixed id the last one counts."""

    SCHEMA = "seq long, ord long, id long, hint string, value string"

    def __init__(self, store: TableStore, keep: int = 200):
        self.store, self.keep = store, keep

    def write(self, hint: str, value: str, seq: int | None = None) -> None:
        m = self.store.manifest()
        n, last = (m["n"] + 1, m["last_id"]) if m else (1, 0)
        own = hint_id(hint, last)
        row = self.store.spark.createDataFrame([(seq, n, own, hint, value)], self.SCHEMA)
        data = [*(m["data"] if m else []), self.store.write_version(row.coalesce(1))]
        if len(data) > self.keep:  # written together, as they are a few rows
            rows = self.store.read(m).union(row)
            each = F.when(F.col("hint") == "drained", F.col("ord"))  # sentinels stay
            few = rows.groupBy("hint", each).agg(F.max_by(F.struct("seq", "ord", "id", "hint", "value"), "ord").alias("r")).select("r.*")
            data = [self.store.write_version(few.coalesce(1))]
        self.store.swap(data, n=n, last_id=max(last, own if own >= FIRST_FREE_ID else 0))
        self.store.vacuum()

    def read(self) -> DataFrame:
        return self.store.read()


def latest(log: DataFrame) -> DataFrame:
    """The table that a log of writes (ord, id, hint, value) leaves: the last value of each hint."""
    return log.groupBy("hint").agg(F.max_by("id", "ord").alias("id"), F.max_by("value", "ord").alias("value"))


def read_hint(log: DataFrame, hint: str) -> DataFrame:
    """The latest value of a hint with a fixed id."""
    return latest(log.where((F.col("hint") == hint) & (F.col("id") < FIRST_FREE_ID)))


def heartbeat_lag(log: DataFrame, now: Column) -> DataFrame:
    """One row: seconds from the last heartbeat to now."""
    beat = log.where("hint = 'heartbeat'").agg(F.max(F.col("value").cast("timestamp")).alias("t"))
    return beat.select((now.cast("timestamp").cast("double") - F.col("t").cast("double")).alias("lag_seconds"))


def replica_lag(lags: DataFrame) -> DataFrame:
    """One row for the worst replica: an error counts above any lag, whatever the order of arrival."""
    worst = F.max(F.struct(F.col("error").isNotNull().alias("failed"), F.coalesce("lag_seconds", F.lit(0.0)).alias("lag"), "replica", "error"))
    return lags.agg(worst.alias("w")).where("w IS NOT NULL").select("w.replica", F.col("w.lag").alias("lag_seconds"), "w.error")


def file_coordinates(text: Column) -> tuple[Column, Column]:
    """'file.number:position' as two numbers to order by; names themselves don't sort once the number gains a digit."""
    return F.regexp_extract(text, r"\.(\d+):(\d+)$", 1).try_cast("bigint"), F.regexp_extract(text, r"\.(\d+):(\d+)$", 2).try_cast("bigint")


def checkpoint_last(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.orderBy(F.desc("id")).limit(1)
