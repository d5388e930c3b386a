"""A whole migration: validate, copy the snapshot, replay the log, check, swap; resumable and revertible."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .control.commands import Commands
from .control.hooks import Hooks
from .control.metrics import Metrics, utilization
from .control.progress import Fatal, retry, status_due
from .control.throttle import CriticalLoad, Gate
from .control.throttle import Metrics as Pressure
from .functions.conversions import convert
from .operators import cdc, checks, cutover
from .operators.copy import first_by_key, project
from .plans import alter as alters
from .plans import chunks, keys
from .plans.predicates import between, lexicographic
from .sources.control import ControlTable
from .sources.store import RunnerLock, TableStore
from .spec import Options, TableSpec, UniqueKey, helper_name
from .streaming.apply import apply_batch, drained, finish

#: Events are applied during the copy once they are this share of what has been copied, as each apply rewrites the buckets it touches.
APPLY_SHARE = 0.1
MAX_WRITES = 1000  # writes of a copy by chunks, at most


@dataclass
class State:
    """Where a migration is; a checkpoint is a row of this."""

    id: int = 0
    at: float = 0.0
    snapshot_seq: int = 0
    applied_seq: int | None = None
    iteration: int = 0
    rows_copied: int = 0
    events_applied: int = 0
    is_cutover: bool = False
    range_min: dict | None = None  # of the last chunks that are written; typed as the key
    range_max: dict | None = None


class Migration:
    """Migrates a stored table to the schema that ``alter`` makes of it.

    The snapshot is pinned at a position of the log (``snapshot_seq``).  All of
    it is copied, at once or chunk by chunk; a chunk is written as it is after
    the events applied so far, and later events go to the rows that have been
    copied.  The log is a DataFrame of raw events or a function that gives it
    as it is now.

    pressure: measures what the throttle looks at; inbox: command lines that
    have come since it was last asked.
    """

    def __init__(
        self, source: TableStore, target: TableStore, spec: TableSpec, alter: str, options: Options | None = None, hooks: Hooks | None = None, gate: Callable[[], None] | None = None,
        metrics: Metrics | None = None, pressure: Callable[[], Pressure] = Pressure, inbox: Callable[[], Iterable[str]] = tuple, sleep: Callable[[float], None] = time.sleep,
    ):
        self.source, self.target, self.options, self.hooks = source, target, options or Options(), hooks or Hooks()
        self.spark: SparkSession = source.spark
        self.spec, self.alter = spec, alters.parse(alter)
        self.metrics, self.pressure, self.inbox, self.sleep = metrics or Metrics(), pressure, inbox, sleep
        self.target_spec = alters.apply_to(spec, self.alter)
        own = lambda kind: TableStore(self.spark, source.root, helper_name(spec.name, kind), single_writer=True)
        self.checkpoints, self.control = own("ghk"), ControlTable(own("ghc"))
        self.state = State()
        self.key: UniqueKey | None = None
        self.target_key: UniqueKey | None = None
        self.shared: list[tuple[str, str]] = []
        self.commands = Commands(self.options, self.status)
        self.gate = gate or Gate(self._pressure, sleep=self._wait)
        self.n_rows, self.began, self.beat, self.interest, self.said = 0, time.time(), 0.0, None, -1
        self.hibernate_until: float | None = None
        self.waited: str | None = None

    # -- preparation

    def validate(self) -> None:
        o = self.options
        if self.alter.renames_table:
            raise ValueError("the statement renames the table")
        if (r := self.alter.real_renames()) and not o.approve_renames and not o.skip_renames:
            raise ValueError(f"columns are renamed {r}: approve or skip it")
        checks.validate(self.spec, o.discard_foreign_keys, o.include_triggers)
        self.validate_key_only()
        names = dict(self.shared)
        missing = [c for c in self.key.columns if c not in names]
        if missing:
            raise ValueError(f"key columns are not shared: {missing}")
        n = checks.null_keys(self.source.read(), self.key.columns).first()[0]
        if n:
            raise ValueError(f"{n} rows have a null in the key {self.key.name}")
        self.hooks.fire("validated", table=self.spec.name)

    def validate_key_only(self) -> None:
        self.key, self.target_key = keys.choose_key(self.spec, self.target_spec, self.alter, self.options.allow_nullable_key)
        self.shared = keys.shared_columns(self.spec, self.target_spec, self.alter, self.options.skip_renames)

    @property
    def mapped_key(self) -> list[str]:
        return [dict(self.shared)[c] for c in self.key.columns]

    @property
    def values(self) -> list[str]:
        return [c.name for c in self.target_spec.columns if c.name not in self.mapped_key]

    @property
    def _how(self) -> dict:
        return {"zone": self.options.timezone, "zero_dates": self.options.allow_zero_dates}

    def form(self, rows: DataFrame, raw: bool = False) -> DataFrame:
        return project(rows, self.spec, self.target_spec, self.shared, raw, **self._how)

    # -- the control plane: between jobs of the run

    def status(self) -> dict:
        done, s = self.state.rows_copied, self.state
        percent = 100.0 if not self.n_rows else min(100.0, 100.0 * done / self.n_rows)
        elapsed = time.time() - self.began
        eta = 0.0 if percent >= 100 else None if percent < 0.1 else elapsed * (self.n_rows - done) / done
        return {"copied": done, "rows": self.n_rows, "percent": percent, "eta": eta, "elapsed": elapsed, "events": s.events_applied, "coordinates": s.applied_seq, "throttled": getattr(self.gate, "last", None)}

    def _pressure(self) -> Pressure:
        """What is measured now, with the options' limits, the user's commands and the flag files."""
        o, m = self.options, self.pressure()
        m.user_command = m.user_command or self.commands.throttled
        m.max_load, m.critical_load, m.max_lag_millis = m.max_load or o.max_load, m.critical_load or o.critical_load, o.max_lag_millis
        m.flag_files = (*m.flag_files, *filter(None, (o.throttle_flag_file,)))
        m.hibernate_until = self.hibernate_until
        return m

    def _wait(self, seconds: float) -> None:
        """A pause of the throttle: commands are still read, and the heart beats."""
        self._listen()
        self._heartbeat()
        self.metrics.gauge("throttle.active", 1)
        self.waited = getattr(self.gate, "last", None) or "cut-over"
        self.sleep(seconds)

    def _measure(self) -> None:
        """Gauges of progress and lag."""
        s, m = self.state, self.pressure()
        self.metrics.gauge("row_copy.rows_copied", s.rows_copied)
        self.metrics.gauge("row_copy.rows_estimate", self.n_rows)
        self.metrics.gauge("dml.events_applied", s.events_applied)
        throttled = str(self.waited is not None).lower()
        self.metrics.gauge("lag.replication_seconds", m.lag_millis / 1000, throttled=throttled)
        self.metrics.gauge("lag.heartbeat_seconds", max(0.0, time.time() - self.beat), throttled=throttled)

    def _backlog(self, size: int) -> None:
        """Positions of the log that are still to be applied, against those of one batch."""
        capacity = self.options.dml_batch_size * cdc.SPAN
        self.metrics.gauge("binlog.backlog_size", size)
        self.metrics.gauge("binlog.backlog_capacity", capacity)
        self.metrics.gauge("binlog.backlog_utilization", utilization(size, capacity))

    def _rest(self, seconds: float) -> None:
        """The pause that the nice ratio asks for."""
        self.metrics.histogram("sleep.duration_milliseconds", 1000 * seconds)
        self.metrics.count("sleep.total_milliseconds", 1000 * seconds)
        self.sleep(seconds)

    def _listen(self) -> None:
        for line in self.inbox():
            answer = self.commands(line)
            self.interest = time.time()
            self.hooks.fire("interactive-command", table=self.spec.name, command=line, answer=answer)
        if self.options.panic_flag_file and self.target._fs.exists(self.target._path(self.options.panic_flag_file)):
            raise Fatal("panic flag file")

    def _heartbeat(self) -> None:
        now = time.time()
        if now - self.beat >= self.options.heartbeat_millis / 1000:
            self.control.write("heartbeat", f"{time.strftime('%Y-%m-%dT%H:%M:%S', time.gmtime(now))}.{int(now % 1 * 1e6):06d}Z")
            self.beat = now

    def turn(self) -> None:
        """Before each piece of work: commands, heartbeat, status, and the throttle."""
        self._listen()
        self._heartbeat()
        s = self.status()
        if int(s["elapsed"]) != self.said and status_due(int(s["elapsed"]), s["eta"], None if self.interest is None else time.time() - self.interest):
            self.said = int(s["elapsed"])
            self._measure()
            self.hooks.fire("status", table=self.spec.name, **s)
        began, self.waited = time.time(), None
        while True:
            try:
                self.gate()
                break
            except CriticalLoad:
                self._critical()
        self.metrics.gauge("throttle.active", 0)
        if self.waited is not None:
            self.metrics.histogram("throttle.duration_milliseconds", 1000 * (time.time() - began), reason=self.waited)
            self.metrics.count("throttle.events_total", 1, reason=self.waited)

    def _critical(self) -> None:
        """A critical load ends the run, unless it is gone after an interval, or the run is to sleep through it."""
        o = self.options
        if o.critical_load_hibernate_seconds:
            self.hibernate_until = time.time() + o.critical_load_hibernate_seconds
            self.control.write("state", "hibernating")
            return
        if not o.critical_load_interval_millis:
            raise
        self.sleep(o.critical_load_interval_millis / 1000)
        m = self._pressure()
        if any(m.load.get(k, 0) >= limit for k, limit in m.critical_load.items()):
            raise

    # -- copy

    def copy_all(self) -> DataFrame:
        """The whole snapshot in the target's schema: one job, all chunks at once."""
        return first_by_key(self.form(self.source.read()), self.mapped_key)

    def groups(self, rows: DataFrame) -> Iterable[tuple[int, list, list, int]]:
        """Neighbouring chunks to be written at once: the last one's number, first and last key, rows."""
        o = self.options
        plan = chunks.plan_chunks(rows, self.key.columns, o.chunk_size).orderBy("chunk_id").toLocalIterator()  # a row for each chunk
        size, low, n, c = max(o.write_rows, self.n_rows // MAX_WRITES), None, 0, None
        ends = lambda c, s: [c[f"{s}_{k}"] for k in self.key.columns]
        for c in plan:
            low, n = ends(c, "min") if low is None else low, n + c["n_rows"]
            if n >= size:
                yield c["chunk_id"], low, ends(c, "max"), n
                low, n = None, 0
        if low is not None:
            yield c["chunk_id"], low, ends(c, "max"), n

    def copy_by_chunks(self, log: Callable[[], DataFrame]) -> None:
        """The snapshot in groups of chunks, each written as files of its own; for a source that must be spared.

        Before each group come commands, throttle and the events of the time
        since, which are applied before more is copied; checkpoints after it.
        """
        src, o, s, t = self.source.read(), self.options, self.state, self.target
        names = [f"{k}" for k in self.key.columns]
        if s.range_max is None:
            t.swap({}, applied_seq=s.applied_seq, buckets=self.source.bucket_count(), schema=self.target_spec.schema().jsonValue())
        else:  # what comes after the last group that is written, whatever the chunks' size is now
            src = src.where(lexicographic(names, [s.range_max[k] for k in names], ">", src.schema))
        saved = time.time()
        for number, lo, hi, n in self.groups(src):
            self.turn()
            self.apply_copied(log)
            began = time.time()
            with self.metrics.timed("query.duration_milliseconds", side="target", kind="copy"):
                retry(lambda lo=lo, hi=hi: self._write_group(src, lo, hi, log), o.max_retries, o.exponential_backoff_max, self.sleep, lambda e: self.hooks.fire("batch-copy-retry", table=self.spec.name, error=str(e)))
            s.iteration, s.rows_copied = number + 1, s.rows_copied + n
            s.range_min, s.range_max = dict(zip(names, lo, strict=True)), dict(zip(names, hi, strict=True))
            self.metrics.gauge("row_copy.rows_copied", s.rows_copied)
            if time.time() - saved >= o.checkpoint_seconds:
                self.checkpoint()
                saved = time.time()
            if o.nice_ratio:
                self._rest(o.nice_ratio * (time.time() - began))
        if s.applied_seq > s.snapshot_seq:  # keys above all that were in the snapshot
            self._write_group(src.limit(0), None, None, log)

    def _write_group(self, src: DataFrame, lo: list | None, hi: list | None, log: Callable[[], DataFrame]) -> None:
        """The rows from key lo to hi, after the events up to the applied position whose keys lie above the last group and up to hi."""
        t, s = self.target, self.state
        m = t.manifest()
        here = src if lo is None else src.where(between(list(self.key.columns), lo, hi, True, src.schema))
        rows = first_by_key(self.form(here), self.mapped_key)
        if s.applied_seq > s.snapshot_seq:
            past = self.events(log().where((F.col("seq") > s.snapshot_seq) & (F.col("seq") <= s.applied_seq)))
            rows = cdc.apply_log(rows, past.where(self._between(hi, s.range_max)), self.mapped_key, self.values).select(*rows.columns)
        new = t.write_buckets(rows, self.mapped_key, m["buckets"])
        data = {b: [*m["data"].get(b, []), *new.get(b, [])] for b in {*m["data"], *new}}
        t.swap(data, **{k: v for k, v in m.items() if k not in ("number", "data")})
        t.vacuum()

    def _between(self, hi: list | None, last: dict | None):
        """The target's keys of a group: above the last one that is copied, up to hi; new keys in between belong to it."""
        schema, out = self.target_spec.schema(), F.lit(True)
        if hi is not None:
            out = out & lexicographic(self.mapped_key, hi, "<=", schema)
        if last is not None:
            out = out & lexicographic(self.mapped_key, [last[k] for k in self.key.columns], ">", schema)
        return out

    def _ordered_alike(self) -> bool:
        """Is the order of keys the same in both tables, so that ranges mean the same?"""
        kind = lambda t: "number" if isinstance(t, T.NumericType) else t.typeName()
        return all(kind(self.spec.column(s).type) == kind(self.target_spec.column(t).type) for s, t in self.shared if s in self.key.columns)

    def apply_copied(self, log: Callable[[], DataFrame]) -> None:
        """Apply what the log has got to the rows that are copied; the others get it with their chunk."""
        s = self.state
        if not self._ordered_alike():
            return
        ends = log().where(F.col("seq") > s.applied_seq).agg(F.max("seq").alias("high"), F.count("*").alias("n")).first()
        if ends.high is None or ends.n < APPLY_SHARE * s.rows_copied:
            return
        upto = ends.high - 1  # the last transaction may be incomplete
        if upto <= s.applied_seq:
            return
        if s.range_max is None:
            m = self.target.manifest()
            self.target.swap(m["data"], **({k: v for k, v in m.items() if k not in ("number", "data")} | {"applied_seq": upto}))
        else:
            copied = lexicographic(self.mapped_key, [s.range_max[k] for k in self.key.columns], "<=", self.target_spec.schema())
            apply_batch(self.target, self.events(log().where((F.col("seq") > s.applied_seq) & (F.col("seq") <= upto))), self.mapped_key, self.values, upto=upto, where=copied)
            s.events_applied += ends.n
        s.applied_seq = upto

    # -- events

    def events(self, log: DataFrame) -> DataFrame:
        """Raw events (before, after images) of the source as events of the target's key and columns."""
        plain = [t for _, t in self.shared]

        def image(side: str):
            cols = [convert(F.col(f"{side}.{s}"), self.spec.column(s), self.target_spec.column(t), True, **self._how).alias(t) for s, t in self.shared]
            return F.struct(*cols).alias(side)

        own = log.select("seq", "sub_seq", "op", image("before"), image("after"))
        key = self.mapped_key
        out = cdc.split_key_updates(own, key, [c for c in plain if c not in key])
        for c in self.target_spec.columns:
            if c.name not in plain and not c.generated:
                out = out.withColumn(c.name, F.expr(c.default).cast(c.type) if c.default is not None else F.lit(None).cast(c.type))
        for c in self.target_spec.columns:
            if c.generated:
                out = out.withColumn(c.name, F.expr(c.generated).cast(c.type))
        return out

    def replay(self, log: DataFrame, close: bool = True) -> int | None:
        """Apply the events after the applied position to the target, in batches of a bounded part of the log; with close to its end."""
        s, step = self.state, self.options.dml_batch_size * cdc.SPAN
        while True:
            rest = log.where(F.col("seq") > (s.applied_seq if s.applied_seq is not None else -1))
            ends = rest.agg(F.min("seq").alias("low"), F.max("seq").alias("high")).first()
            if ends.low is None or (not close and ends.low == ends.high):
                return s.applied_seq
            upto = min(ends.low + step - 1, ends.high if close else ends.high - 1)
            part = rest.where(F.col("seq") <= upto)
            n = part.count()
            if self.options.panic_on_warnings and (found := checks.batch_warnings(self.target.read(), self.events(part), self.target_spec, self.mapped_key)):
                raise Fatal("; ".join(found))
            self._backlog(ends.high - ends.low + 1)
            with self.metrics.timed("query.duration_milliseconds", side="target", kind="apply"):  # after a failure again from the applied position
                retry(lambda part=part, upto=upto: apply_batch(self.target, self.events(part), self.mapped_key, self.values, upto=upto), self.options.max_retries, self.options.exponential_backoff_max, self.sleep)
            s.applied_seq, s.events_applied = upto, s.events_applied + n
            self.metrics.gauge("dml.events_applied", s.events_applied)
            if upto >= (ends.high if close else ends.high - 1):
                return s.applied_seq

    # -- the whole

    def run(self, log: DataFrame | Callable[[], DataFrame], snapshot_seq: int = 0, chunked: bool = False, resume: bool = False) -> dict:
        """Copy, replay, check and swap; returns the manifest of the swapped table (or, without execute, the plan)."""
        now = log if callable(log) else lambda: log
        with RunnerLock(self.source):
            try:
                self.hooks.fire("startup", table=self.spec.name)
                self.validate()
                if not self.options.execute:
                    return {"executed": False, "key": list(self.key.columns), "columns": self.shared}
                if self.options.attempt_instant and alters.instant(self.alter):
                    return self._instant(now(), snapshot_seq)
                self._count()
                last = self.last_checkpoint() if resume else None
                self.state = self._resumed(last) if last and not last.is_cutover and self.target.exists() else State(snapshot_seq=snapshot_seq, applied_seq=snapshot_seq)
                self.hooks.fire("before-row-copy", table=self.spec.name)
                if chunked:
                    self.copy_by_chunks(now)
                else:
                    self.turn()
                    retry(self._write_all, self.options.max_retries, self.options.exponential_backoff_max, self.sleep)
                self._warned()
                self.hooks.fire("row-copy-complete", table=self.spec.name)
                self.replay(now(), close=False)
                return self.cut_over(now)
            except Exception as e:
                self.hooks.fire("failure", table=self.spec.name, error=str(e))
                raise

    def _count(self) -> None:
        n = None if self.options.exact_rowcount else checks.row_estimate(self.source.read())
        self.n_rows = checks.row_count(self.source.read()).first()[0] if n is None else n
        self.hooks.fire("rowcount-complete", table=self.spec.name, rows=self.n_rows)

    def _resumed(self, last: State) -> State:
        """The checkpoint's state; groups of chunks that the target got after it are written again, so it is set back to the checkpoint."""
        m = self.target.manifest()
        last.applied_seq = m["applied_seq"]  # events that came to the copied rows since
        if last.range_max is not None:
            key = self.mapped_key
            beyond = self.target.read().where(lexicographic(key, [last.range_max[k] for k in self.key.columns], ">", self.target_spec.schema()))
            if not beyond.isEmpty():
                kept = self.target.read().where(lexicographic(key, [last.range_max[k] for k in self.key.columns], "<=", self.target_spec.schema()))
                self.target.swap(self.target.write_buckets(kept, key, m["buckets"]), **{k: v for k, v in m.items() if k not in ("number", "data")})
        return last

    def _write_all(self) -> None:
        t = self.target
        rows, n = self.copy_all(), self.source.bucket_count()
        t.swap(t.write_buckets(rows, self.mapped_key, n), applied_seq=self.state.applied_seq, buckets=n, schema=self.target_spec.schema().jsonValue())
        self.state.rows_copied = self.n_rows

    def _warned(self) -> None:
        if self.options.panic_on_warnings and (found := checks.warnings(self.target.read(), self.target_spec, self.mapped_key)):
            raise Fatal("; ".join(found))

    def _instant(self, log: DataFrame, snapshot_seq: int) -> dict:
        """Only the schema changes: the same files, read with the new columns; later events are then applied to them."""
        old = self.source.manifest()
        body = {k: v for k, v in old.items() if k not in ("number", "data")} | {"applied_seq": snapshot_seq, "old": _old(old), "schema": self.target_spec.schema().jsonValue()}
        self.source.swap(old["data"], **body)
        later = log.where(F.col("seq") > snapshot_seq)
        self.state.applied_seq = apply_batch(self.source, self.events(later), self.mapped_key, self.values, close=True)
        self.state.is_cutover = True
        self.checkpoint()
        self.hooks.fire("success", table=self.spec.name)
        return self.source.manifest()

    def _may_cut_over(self) -> None:
        """Wait until nothing speaks against a swap: throttle, lag, postponement."""
        told = False
        while True:
            self.turn()
            o, m = self.options, self._pressure()
            flag = bool(o.postpone_flag_file) and self.target._fs.exists(self.target._path(o.postpone_flag_file))
            why = cutover.gate(m.lag_millis, o.max_lag_millis, o.lock_timeout_millis, self.commands.postponed or flag, None)
            if why is None:
                return
            if why == "postponed" and not told:
                self.hooks.fire("begin-postponed", table=self.spec.name)
                told = True
            self._wait(0.25)

    def cut_over(self, log: Callable[[], DataFrame]) -> dict:
        """Swap the target in: one manifest of the source names the target's folders, and the old ones for a revert; no data is written."""
        self._may_cut_over()
        self.hooks.fire("before-cut-over", table=self.spec.name)
        outcome = "error"
        try:
            with self.metrics.timed("cut_over.total_duration_milliseconds"):
                m, old = self._critical_part(log)
            outcome = "success"
        finally:
            self.metrics.count("cut_over.attempts_total", 1, outcome=outcome)
        self.state.is_cutover = True
        self.checkpoint()
        if self.options.ok_to_drop:
            self.source.drop_data(old)
            self.old_table().drop()
        self.target.release()
        self.hooks.fire("success", table=self.spec.name)
        return m

    def _critical_part(self, log: Callable[[], DataFrame]) -> tuple[dict, dict]:
        """Drain the log up to a sentinel, check, and swap; nothing waits here."""
        o, s, phase = self.options, self.state, lambda p: self.metrics.timed("cut_over.phase_duration_milliseconds", phase=p)
        self.hooks.fire("stop-replication", table=self.spec.name)
        try:
            if isinstance(self.gate, Gate):
                self.gate.suppressed = True
            with phase("drain"):
                final = log()
                end = final.agg(F.max("seq")).first()[0]
                sentinel = f"drained:{uuid.uuid4().hex}"
                self.control.write("drained", sentinel, seq=(end if end is not None and end > s.applied_seq else s.applied_seq) + 1)
                self.replay(final, close=True)
                finish(self.target, self.mapped_key, self.values)
                if not drained(self.control.read(), sentinel, s.applied_seq):
                    raise Fatal("the log is not drained")
            self._warned()
            if o.analyze_before_cutover:
                self.n_rows = checks.row_count(self.target.read()).first()[0]
                self.metrics.gauge("row_copy.rows_estimate", self.n_rows)
            with phase("swap"):
                return self._swap()
        finally:
            if isinstance(self.gate, Gate):
                self.gate.suppressed = False
            self.hooks.fire("start-replication", table=self.spec.name)

    def old_table(self) -> TableStore:
        """The version before the swap, under its own name."""
        return TableStore(self.spark, self.source.root, helper_name(self.spec.name, "del", self.began if self.options.timestamp_old_table else None), single_writer=True)

    def _swap(self) -> tuple[dict, dict]:
        old, new = self.source.manifest(), self.target.manifest()
        facts = {"applied_seq": self.state.applied_seq, "old": _old(old), "next_id": self.target_spec.next_id, "buckets": new.get("buckets"), "schema": new["schema"]}
        self.old_table().swap(old["data"], **{k: v for k, v in _old(old).items() if k != "data"})
        if self.options.two_step_cutover:
            self.source.swap([], missing=True, old=_old(old))
            try:
                return self.source.swap(new["data"], **facts), old
            except Exception:
                self.source.swap(old["data"], **{k: v for k, v in old.items() if k not in ("number", "data")})
                raise
        return self.source.swap(new["data"], **facts), old

    # -- checkpoints and revert

    def _checkpoint_schema(self) -> T.StructType:
        key = T.StructType([self.spec.column(k).field() for k in self.key.columns])
        plain = [("id", T.LongType()), ("at", T.DoubleType()), ("snapshot_seq", T.LongType()), ("applied_seq", T.LongType()), ("iteration", T.LongType()), ("rows_copied", T.LongType()), ("events_applied", T.LongType()), ("is_cutover", T.BooleanType())]
        return T.StructType([*(T.StructField(n, t) for n, t in plain), T.StructField("range_min", key), T.StructField("range_max", key)])

    def checkpoint(self) -> None:
        """Add a row to the checkpoint table: one more folder."""
        s, c = self.state, self.checkpoints
        s.id, s.at = s.id + 1, time.time()
        schema = self._checkpoint_schema()
        row = asdict(s)
        df = self.spark.createDataFrame([tuple(tuple(row[f.name].values()) if isinstance(row[f.name], dict) else row[f.name] for f in schema.fields)], schema)
        before = c.manifest()
        c.swap([*(before["data"] if before else []), c.write_version(df)])

    def last_checkpoint(self) -> State | None:
        if not self.checkpoints.exists():
            return None
        r = self.checkpoints.read().orderBy(F.desc("id")).limit(1).first()
        if r is None:
            return None
        d = r.asDict(recursive=True)
        return State(**(d | {k: d[k] if d[k] and any(v is not None for v in d[k].values()) else None for k in ("range_min", "range_max")}))

    def revert(self, log: DataFrame) -> dict:
        """Return to the old version: it gets the events that it lacks, those since the snapshot, then it is current again.  log: events of the old schema."""
        self.validate_key_only()
        last = self.last_checkpoint()
        if last is None or not last.is_cutover:
            raise ValueError("only a migration that has been swapped in can be reverted")
        m = self.source.manifest()
        key, values = list(self.key.columns), [c.name for c in self.spec.columns if c.name not in self.key.columns]
        back = TableStore(self.spark, self.source.root, helper_name(self.spec.name, "del", self.began, revert=True), single_writer=True)
        old = m["old"]
        since = last.snapshot_seq if old.get("applied_seq") is None else old["applied_seq"]
        back.swap(old["data"], **({k: v for k, v in old.items() if k != "data"} | {"applied_seq": since, "schema": old.get("schema") or self.spec.schema().jsonValue()}))
        since = cdc.split_key_updates(log.where(F.col("seq") > since), key, values)
        seq = apply_batch(back, since, key, values, close=True)
        new = back.manifest()
        body = {k: v for k, v in new.items() if k not in ("number", "data")} | {"applied_seq": seq, "old": _old(m), "reverted": True}
        return self.source.swap(new["data"], **body)


def _old(m: dict) -> dict:
    """What a manifest keeps of the version before it."""
    return {k: m[k] for k in ("data", "schema", "buckets", "applied_seq") if k in m}
