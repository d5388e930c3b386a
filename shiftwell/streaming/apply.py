"""Applying a change stream to a stored table, exactly once, in order, and without loss.

Events are rows of seq, sub_seq, op, key and values; those of one seq are one
transaction.  What is known to be complete is folded into the table; the rest,
at least the last transaction, is held in the store until the events after it
have come.  An event of a transaction that has been applied already is an
error, never dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..control.progress import Fatal
from ..operators.cdc import apply_log
from ..sources.store import TableStore

SENTINEL = "drained"


class LateEvents(Fatal):
    """Events came after the transactions they belong before, or to, had been applied."""


def apply_batch(
    store: TableStore, events: DataFrame, key: Sequence[str], values: Sequence[str], batch_id: int | None = None, upto: int | None = None, close: bool = False, where=None,
) -> int | None:
    """Fold a batch, and what earlier ones left, into the table; the position that is applied.

    upto: transactions up to it are known to be complete, those after it are
    held.  By default all but the last one are; with ``close`` (the log ends
    here) all.  A batch id that came before does nothing.  where: of the rows
    that apply, those that the table is to take (the others count as applied).
    Only the buckets that hold touched keys are rewritten.
    """
    m = store.manifest()
    done, held = m.get("applied_seq"), list(m.get("held") or [])
    if batch_id is not None and m.get("batch_id", -1) >= batch_id:
        return done
    ends = events.agg(F.min("seq").alias("low"), F.max("seq").alias("high")).first()
    if ends.low is not None and done is not None and ends.low <= done:
        raise LateEvents(f"{store.name}: events from position {ends.low} on came after position {done} had been applied")
    high = max([h["high"] for h in held] + ([ends.high] if ends.high is not None else []), default=None)
    if upto is None and high is not None:
        upto = high if close else high - 1
    facts = {k: v for k, v in m.items() if k not in ("number", "data", "held", "applied_seq", "batch_id")}
    facts["batch_id"] = m.get("batch_id", -1) if batch_id is None else batch_id
    kinds = ["seq", "sub_seq", "op", *key, *values]
    parts, rest, data = [], [], m["data"]
    for h in held:
        if upto is not None and h["low"] <= upto:
            parts.append(store.spark.read.parquet(f"{store.root}/{h['at']}").where(F.col("seq").between(h["low"], upto)))
        if upto is None or h["high"] > upto:
            rest.append(h if upto is None else h | {"low": max(h["low"], upto + 1)})
    if ends.low is not None and upto is not None and ends.low <= upto:
        parts.append(events.where(F.col("seq") <= upto).select(*kinds))
    if ends.high is not None and (upto is None or ends.high > upto):
        late = events if upto is None else events.where(F.col("seq") > upto)
        rest.append({"at": store.write_version(late.select(*kinds)), "low": ends.low if upto is None else max(ends.low, upto + 1), "high": ends.high})
    if parts:
        fresh = parts[0]
        for p in parts[1:]:
            fresh = fresh.unionByName(p)
        data = _rewrite(store, m, fresh if where is None else fresh.where(where), key, values)
        facts |= {"buckets": m["buckets"], "schema": m["schema"]}
        done = min(upto, high) if done is None else max(done, min(upto, high))
    if parts or rest != held or batch_id is not None:
        store.swap(data, applied_seq=done, held=rest, **facts)
        store.vacuum()
    return done


def _rewrite(store: TableStore, m: dict, events: DataFrame, key: Sequence[str], values: Sequence[str]) -> dict[str, list[str]]:
    """The table's folders by bucket after the events; buckets without events keep theirs."""
    if isinstance(m["data"], dict):
        n = m["buckets"]
        touched = [r[0] for r in events.select(store.bucket_of(key, n)).distinct().collect()]  # at most n numbers
        base = store.read(m, touched) if any(str(b) in m["data"] for b in touched) or not m["data"] else store.read(m).limit(0)
        kept = {b: p for b, p in m["data"].items() if int(b) not in touched}
    else:  # folders without buckets: all rows are dealt, once
        n, base, kept = store.bucket_count(), store.read(m), {}
    m["buckets"] = n
    m.setdefault("schema", base.schema.jsonValue())
    out = apply_log(base, events, key, values).select(*base.columns)
    return kept | store.write_buckets(out, key, n)


class Listeners:
    """Listeners by table (names in any case); each gets its table's events of a batch, and errors stop the batch."""

    def __init__(self) -> None:
        self._all: list[tuple[str, str, Callable[[DataFrame, int], None]]] = []

    def add(self, db: str, table: str, listener: Callable[[DataFrame, int], None]) -> None:
        self._all.append((db.lower(), table.lower(), listener))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        for db, table, listener in self._all:
            listener(batch.where((F.lower("db") == db) & (F.lower("table") == table)), batch_id)


def replay_stream(stream: DataFrame, store: TableStore, form: Callable[[DataFrame], DataFrame], key: Sequence[str], values: Sequence[str], checkpoint: str, gate: Callable[[], None] | None = None, files: DataFrame | None = None):
    """Run the stream to its present end.  form: raw events to (seq, sub_seq, op, key, values); gate: waits while throttled.

    Files come in the order of their times, which need not be the log's.
    files (file, low: its least seq; ``changelog.file_bounds``) tells what is
    still to come, and so up to where the log is complete; the stream's events
    then need the column ``file``.  Without it the files must come in order:
    late events are an error.  The log's last transaction is held until
    ``finish``, as its other part may be written later.
    """
    spark, seen = store.spark, f"{checkpoint}-files"

    def batch(df: DataFrame, batch_id: int) -> None:
        if gate:
            gate()
        df.persist()
        try:
            upto = None
            if files is not None:
                df.select("file").distinct().write.mode("overwrite").parquet(f"{seen}/batch={batch_id}")
                to_come = files.join(spark.read.parquet(seen).select("file"), "file", "left_anti").agg(F.min("low")).first()[0]
                upto = None if to_come is None else to_come - 1
            apply_batch(store, form(df), key, values, batch_id, upto)
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finish(store: TableStore, key: Sequence[str], values: Sequence[str]) -> int | None:
    """Apply what is held: the log has ended."""
    m = store.manifest()
    if not m.get("held"):
        return m.get("applied_seq")
    none = store.spark.read.parquet(*(f"{store.root}/{h['at']}" for h in m["held"])).limit(0)
    return apply_batch(store, none, key, values, close=True)


def drained(control: DataFrame, sentinel: str, applied_seq: int | None) -> bool:
    """Has all been applied that came before the sentinel (a control row seq, hint, value)?  Others' sentinels count for nothing."""
    row = control.where((F.col("hint") == SENTINEL) & (F.col("value") == sentinel)).agg(F.max("seq")).first()
    return row[0] is not None and applied_seq is not None and applied_seq >= row[0] - 1


def safe_position(entries: DataFrame) -> DataFrame:
    """One row: the last position at which a transaction is complete.  entries: seq, kind (row, commit)."""
    return entries.agg(F.max(F.when(F.col("kind") == "commit", F.col("seq"))).alias("safe_seq"))
