"""Whole migrations on stored tables: fixtures of schema, log, change and expected rows."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import types as T

from shiftwell.control.hooks import EVENTS, Hooks
from shiftwell.control.metrics import NAMES, Metrics
from shiftwell.control.throttle import Metrics as Pressure
from shiftwell.migrate import Migration
from shiftwell.operators import checks
from shiftwell.sources.changelog import event_schema, stream_log
from shiftwell.sources.store import RunnerLock, TableStore
from shiftwell.spec import Column, Options, TableSpec, UniqueKey
from shiftwell.sources.changelog import file_bounds
from shiftwell.streaming.apply import LateEvents, Listeners, apply_batch, drained, finish, replay_stream

COLS = (Column("id", T.IntegerType(), False), Column("c1", T.IntegerType()), Column("c2", T.StringType()))
SPEC = TableSpec("t", COLS, (UniqueKey("PRIMARY", ("id",)),))


def log_of(spark, events, spec=SPEC):
    return spark.createDataFrame(events, event_schema([c.field() for c in spec.columns]))


@pytest.fixture
def stores(spark, tmp_path):
    source, target = TableStore(spark, str(tmp_path), "t"), TableStore(spark, str(tmp_path), "_t_gho")
    rows = [(i, i * 10, f"v{i}") for i in range(200)]
    source.swap(source.write_version(spark.createDataFrame(rows, SPEC.schema())), applied_seq=0)
    return source, target


def events(seed=1):
    rng, table, out = random.Random(seed), {i: (i, i * 10, f"v{i}") for i in range(200)}, []
    for s in range(1, 301):
        k = rng.randrange(260)
        if k in table:
            if rng.random() < 0.4:
                out.append((s, 0, "d", "t", "D", table.pop(k), None))
            else:
                new = (rng.randrange(260, 400) if rng.random() < 0.2 else k, s, f"u{s}")
                if new[0] != k and new[0] in table:
                    continue
                out.append((s, 0, "d", "t", "U", table.pop(k), new))
                table[new[0]] = new
        else:
            table[k] = (k, s, f"i{s}")
            out.append((s, 0, "d", "t", "I", None, table[k]))
    return out, table


@pytest.mark.parametrize("chunked", [False, True])
def test_migration_equals_source(spark, stores, chunked):
    source, target = stores
    ev, want = events()
    fired = []
    hooks = Hooks()
    for e in ("startup", "validated", "before-row-copy", "row-copy-complete", "before-cut-over", "success"):
        hooks.on(e, lambda f, e=e: fired.append(e))
    m = Migration(source, target, SPEC, "CHANGE c2 name varchar(64), ADD COLUMN tier int NOT NULL DEFAULT 3, MODIFY c1 bigint", Options(approve_renames=True, chunk_size=30), hooks)
    m.run(log_of(spark, ev), chunked=chunked)
    got = {tuple(r) for r in source.read().collect()}
    assert got == {(k, c1, c2, 3) for k, c1, c2 in want.values()}
    assert fired == ["startup", "validated", "before-row-copy", "row-copy-complete", "before-cut-over", "success"]
    assert m.last_checkpoint().is_cutover and not target.exists()
    # revert: the old version gets all events since the snapshot, those after the swap too
    more = [(1000, 0, "d", "t", "I", None, (900, 1, "x")), (1001, 0, "d", "t", "D", next(iter(want.values())), None)]
    m2 = Migration(source, target, SPEC, "CHANGE c2 name varchar(64), ADD COLUMN tier int NOT NULL DEFAULT 3, MODIFY c1 bigint", Options(approve_renames=True))
    m2.revert(log_of(spark, [*ev, *more]))
    now = set(want.values()) | {(900, 1, "x")}
    assert {tuple(r) for r in source.read().collect()} == {r for r in now if r[0] != next(iter(want.values()))[0]}


def test_noop_and_refusals(spark, stores):
    source, target = stores
    none = log_of(spark, [])
    assert Migration(source, target, SPEC, "engine=innodb", Options(execute=False)).run(none)["key"] == ["id"]
    with pytest.raises(ValueError, match="renamed"):
        Migration(source, target, SPEC, "change c1 c9 int").run(none)
    with pytest.raises(ValueError, match="renames the table"):
        Migration(source, target, SPEC, "rename as x").run(none)
    with pytest.raises(ValueError, match="child-side"):
        Migration(source, target, TableSpec("t", COLS, SPEC.keys, foreign_keys_child=1), "engine=innodb").run(none)
    with RunnerLock(source), pytest.raises(RuntimeError, match="already"):
        Migration(source, target, SPEC, "engine=innodb").run(none)


def test_panic_on_warnings(spark, stores):
    source, target = stores
    dup = [(1, 0, "d", "t", "I", None, (500, 1, "v1"))]
    for statement, why in (("add unique key n (c2)", "Duplicate entry 'v1' for key 'n'"), ("modify c2 varchar(2)", "Data truncated")):
        with pytest.raises(Exception, match=why):
            Migration(source, target, SPEC, statement, Options(panic_on_warnings=True, max_retries=1)).run(log_of(spark, dup))


def test_instant_change(spark, stores):
    source, target = stores
    ev, want = events(3)
    Migration(source, target, SPEC, "add column note varchar(9)", Options(attempt_instant=True)).run(log_of(spark, ev))
    assert {tuple(r) for r in source.read().collect()} == {(*r, None) for r in want.values()}


EVENT = "seq long, sub_seq long, op string, id int, c1 int, c2 string"


def test_batches_are_applied_once(spark, stores):
    source, _ = stores
    ev = spark.createDataFrame([(1, 0, "U", 5, 1, "a"), (2, 0, "D", 6, None, None)], EVENT)
    assert apply_batch(source, ev, ["id"], ["c1", "c2"], 0) == 1  # the last transaction may go on
    n = source.manifest()["number"]
    assert apply_batch(source, ev, ["id"], ["c1", "c2"], 0) == 1 and source.manifest()["number"] == n
    assert finish(source, ["id"], ["c1", "c2"]) == 2 and not source.manifest()["held"]
    assert source.read().count() == 199 and source.read().where("id = 5").first().c2 == "a"
    control = spark.createDataFrame([(3, "drained", "me"), (9, "drained", "old")], "seq long, hint string, value string")
    assert drained(control, "me", 2) and not drained(control, "old", 2) and not drained(control, "none", 99)


def test_split_transactions_lose_nothing(spark, stores):
    """A transaction over two batches, and one that comes before it: all three rows are there; what is late is an error."""
    source, _ = stores
    put = lambda rows, b, **k: apply_batch(source, spark.createDataFrame([(s, n, "I", 1000 + 10 * s + n, s, "x") for s, n in rows], EVENT), ["id"], ["c1", "c2"], b, **k)
    assert put([(5, 0)], 0) == 0
    assert put([(5, 1), (4, 0)], 1) == 4
    assert put([(7, 0)], 2) == 6
    with pytest.raises(LateEvents):
        put([(5, 2)], 3)
    finish(source, ["id"], ["c1", "c2"])
    assert sorted(r.id for r in source.read().where("id >= 1000").collect()) == [1040, 1050, 1051, 1070]


def test_only_touched_buckets_are_rewritten(spark, stores):
    source, _ = stores
    one = lambda s, k: apply_batch(source, spark.createDataFrame([(s, 0, "U", k, s, "n")], EVENT), ["id"], ["c1", "c2"], close=True)
    one(1, 5)
    before = source.manifest()["data"]
    one(2, 7)
    after = source.manifest()["data"]
    bucket = str(spark.range(1).select(source.bucket_of([T_lit(7)], source.manifest()["buckets"])).first()[0])
    assert {b for b in before if before[b] != after[b]} == {bucket} and len(before) > 1
    for s in range(3, 9):
        one(s, s)
    assert len(source._numbers()) == 3 and source.read().count() == 200 and source.read().where("c2 = 'n'").count() == 6


def T_lit(v):
    from pyspark.sql import functions as F

    return F.lit(v).cast("int")


@pytest.mark.parametrize("shuffled", [False, True])
def test_stream_equals_batch(spark, stores, tmp_path, shuffled):
    source, _ = stores
    ev, want = events(5)
    ev = [(s // 3 + 1, s % 3, *rest) for s, _, *rest in ev]  # transactions of three, some split over files
    files = str(tmp_path / "log")
    parts = [ev[k * 40 : k * 40 + 40] for k in range((len(ev) + 39) // 40)]
    if shuffled:
        random.Random(1).shuffle(parts)
    for part in parts:
        log_of(spark, part).coalesce(1).write.mode("append").parquet(files)
    from shiftwell.operators.cdc import split_key_updates

    schema = event_schema([c.field() for c in COLS])
    bounds = file_bounds(spark, files, schema)
    q = replay_stream(stream_log(spark, files, schema, 2), source, lambda df: split_key_updates(df, ["id"], ["c1", "c2"]), ["id"], ["c1", "c2"], str(tmp_path / f"cp{uuid.uuid4().hex}"), files=bounds)
    q.awaitTermination()
    finish(source, ["id"], ["c1", "c2"])
    assert {tuple(r) for r in source.read().collect()} == set(want.values())


def test_listeners(spark):
    seen = []
    ls = Listeners()
    ls.add("D", "T", lambda df, b: seen.append((b, df.count())))
    ls(spark.createDataFrame([("d", "t"), ("d", "x")], "db string, table string"), 4)
    assert seen == [(4, 1)]

    def boom(df, b):
        raise RuntimeError("kept")

    ls.add("d", "x", boom)
    with pytest.raises(RuntimeError):
        ls(spark.createDataFrame([("d", "x")], "db string, table string"), 5)


def test_checksums(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    b = spark.createDataFrame([(2, None), (1, "x")], "i int, s string")
    assert checks.same_rows(a, b, ["i", "s"], ["i", "s"]).first()["equal"]
    assert not checks.same_rows(a, b.union(b), ["i", "s"], ["i", "s"]).first()["equal"]


@pytest.mark.parametrize("size", [25, 40])
def test_resume_after_an_abort(spark, stores, size):
    """Resumed by the last key that is written, also with chunks of another size."""
    source, target = stores
    ev, want = events(7)
    calls = []

    def gate():
        calls.append(1)
        if len(calls) == 6:
            raise RuntimeError("lost")

    def options(n):
        o = Options(chunk_size=n, max_retries=1, write_rows=n)
        o.checkpoint_seconds = 0  # after every group
        return o

    m = Migration(source, target, SPEC, "add column tier int not null default 3", options(25), gate=gate)
    with pytest.raises(RuntimeError, match="lost"):
        m.run(log_of(spark, ev), chunked=True)
    last = m.last_checkpoint()
    assert last.rows_copied == 125 and last.range_max == {"id": 124} and not last.is_cutover
    again = Migration(source, target, SPEC, "add column tier int not null default 3", options(size))
    again.run(log_of(spark, ev), chunked=True, resume=True)
    assert {tuple(r) for r in source.read().collect()} == {(*r, 3) for r in want.values()}
    assert again.state.rows_copied == 200


def test_events_during_the_copy(spark, stores):
    """The log grows while chunks are copied: deletes, inserts and key changes on both sides of what is copied."""
    source, target = stores
    ev, want = events(11)
    calls, n = [], [0]

    def log():
        return log_of(spark, ev[: n[0]])

    def gate():
        calls.append(1)
        n[0] = min(len(ev), 45 * len(calls))

    metrics = Metrics()
    m = Migration(source, target, SPEC, "add column tier int not null default 3", Options(chunk_size=20, write_rows=20, panic_on_warnings=True), gate=gate, metrics=metrics)
    m.run(log, chunked=True)
    n[0] = len(ev)
    assert {tuple(r) for r in source.read().collect()} == {(*r, 3) for r in want.values()}
    assert m.state.events_applied > 0 and len(calls) >= 10
    names = {n.removeprefix("shiftwell.") for _, _, n, _, _ in metrics.rows}
    assert names <= set(NAMES) and {"row_copy.rows_copied", "dml.events_applied", "query.duration_milliseconds", "cut_over.attempts_total", "binlog.backlog_utilization"} <= names


def test_cut_over_writes_no_data(spark, stores, tmp_path):
    source, target = stores
    m = Migration(source, target, SPEC, "add column tier int not null default 3")
    m.run(log_of(spark, []))
    assert all(p.startswith("_t_gho/") for own in source.manifest()["data"].values() for p in own)
    assert not target.exists() and m.old_table().read().count() == 200 and source.read().count() == 200
    with pytest.raises(ValueError, match="atomic"):
        TableStore.__init__(TableStore.__new__(TableStore), spark, "http://nowhere/x", "t")


def test_control_plane(spark, stores, tmp_path):
    """Commands, postponement, hooks, heartbeat, critical load and flag files take part in a run."""
    source, target = stores
    fired, lines, waits = [], [["throttle"], ["no-throttle", "postpone"], ["chunk-size=50"], ["unpostpone"]], []
    hooks = Hooks()
    for e in EVENTS:
        hooks.on(e, lambda f, e=e: fired.append(e))
    load = iter([1, 9] + [1] * 1000)
    o = Options(critical_load={"x": 5}, critical_load_interval_millis=5, two_step_cutover=True, analyze_before_cutover=True, timestamp_old_table=True)
    m = Migration(source, target, SPEC, "add column tier int not null default 3", o, hooks, pressure=lambda: Pressure(load={"x": next(load)}), inbox=lambda: lines.pop(0) if lines else [], sleep=waits.append)
    m.run(log_of(spark, []))
    assert {"rowcount-complete", "begin-postponed", "interactive-command", "status", "stop-replication", "start-replication", "success"} <= set(fired)
    names = {n.removeprefix("shiftwell."): t for _, _, n, _, t in m.metrics.rows}
    assert names["throttle.events_total"] == {"reason": "commanded by user"} and names["cut_over.attempts_total"] == {"outcome": "success"}
    assert waits and o.chunk_size == 50 and m.control.read().where("hint = 'heartbeat'").count() > 0
    assert m.control.read().where("hint = 'drained'").count() == 1 and len(m.old_table().name) > len("_t_del")
    again = Migration(source, target, m.target_spec, "add column more int", Options(panic_flag_file=str(tmp_path)))
    with pytest.raises(Exception, match="panic"):
        again.run(log_of(spark, [], m.target_spec))
    busy = Migration(source, target, m.target_spec, "add column more int", Options(critical_load={"x": 5}), pressure=lambda: Pressure(load={"x": 9}))
    with pytest.raises(Exception, match="critical-load"):
        busy.run(log_of(spark, [], m.target_spec))


def test_warnings_in_the_middle_of_a_batch(spark, stores):
    """A duplicate that a later event of the batch takes back is still one; a value that is free by then is none."""
    source, target = stores
    bad = [(1, 0, "d", "t", "I", None, (500, 1, "v1")), (2, 0, "d", "t", "D", (500, 1, "v1"), None)]
    fine = [(1, 0, "d", "t", "D", (1, 10, "v1"), None), (2, 0, "d", "t", "I", None, (500, 1, "v1"))]
    run = lambda ev: Migration(source, target, SPEC, "add unique key n (c2)", Options(panic_on_warnings=True, max_retries=1)).run(log_of(spark, ev))
    with pytest.raises(Exception, match="Duplicate entry 'v1' for key 'n'"):
        run(bad)
    run(fine)
    assert source.read().where("c2 = 'v1'").first().id == 500


def test_a_lock_left_behind(spark, stores):
    source, _ = stores
    lock = RunnerLock(source)
    assert source._fs.createNewFile(lock.file)
    source._fs.setTimes(lock.file, 1000, -1)
    with RunnerLock(source), pytest.raises(RuntimeError, match="already"):
        RunnerLock(source).__enter__()
