"""Back-pressure, progress, retries, commands, hooks, configuration, conversions."""

from __future__ import annotations

import stat

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftwell.control import commands, hooks, metrics, progress, throttle
from shiftwell.functions import conversions as conv
from shiftwell.sources.config import read_config
from shiftwell.sources.control import hint_id
from shiftwell.spec import Options


def test_throttle_order():
    m = throttle.Metrics(hibernate_until=10, user_command=True, lag_millis=9000)
    assert throttle.reason(m, now=5) == "critical-load-hibernate" and throttle.reason(m, now=11) == "commanded by user"
    assert throttle.reason(throttle.Metrics(load={"a": 5}, max_load={"a": 5})) == "max-load a=5 >= 5"
    assert throttle.reason(throttle.Metrics(http_status=-1)) == "http=-1"
    assert throttle.reason(throttle.Metrics(lag_millis=1501)) == "lag=1.501s" and throttle.reason(throttle.Metrics(lag_millis=1500)) is None
    assert throttle.reason(throttle.Metrics(replica="r", replica_error="x")) == "r replica-lag error: x"
    with pytest.raises(throttle.CriticalLoad):
        throttle.reason(throttle.Metrics(load={"a": 9}, critical_load={"a": 9}))


def test_gate(spark):
    state, slept = [throttle.Metrics(query_result=1), throttle.Metrics(query_result=1), throttle.Metrics()], []
    throttle.Gate(lambda: state.pop(0), sleep=slept.append)()
    assert len(slept) == 2
    g = throttle.Gate(lambda: throttle.Metrics(user_command=True))
    g.suppressed = True
    g()
    assert throttle.query_result(spark, "select 3") == 3 and throttle.http_status("http://127.0.0.1:9/") == -1 and throttle.http_status("http://127.0.0.1:9/", ignore_errors=True) == 200


def test_retry():
    slept, calls = [], []

    def fails():
        calls.append(1)
        raise OSError("again")

    with pytest.raises(OSError):
        progress.retry(fails, 5, 4, slept.append)
    assert len(calls) == 5 and slept == [1, 2, 4, 4]

    def fatal():
        calls.append(1)
        raise progress.Fatal("warnings")

    with pytest.raises(progress.Fatal):
        progress.retry(fatal, 5, sleep=slept.append)
    assert len(calls) == 6 and progress.pretty(3725) == "1h2m5s" and progress.pretty(9) == "9s"
    assert progress.status_due(7, None) and not progress.status_due(601, 9999) and progress.status_due(660, 9999) and progress.status_due(630, 9999)
    assert progress.status_due(901, 59) and progress.status_due(905, 170) and not progress.status_due(903, 170) and progress.status_due(905, 9999, 30) and not progress.status_due(905, 9999, 61)


def test_commands():
    o = Options()
    c = commands.Commands(o, lambda: {"coordinates": "bin.000001:4"})
    assert c("chunk-size=250") == "250" and o.chunk_size == 250 and c("chunk-size=?") == "250" and c("chunk-size=1") == "10"
    assert c("max-load=Threads_running=25,x=1") == "Threads_running=25,x=1" and c("coordinates") == "bin.000001:4"
    c("throttle")
    assert c.throttled
    c("continue"), c("postpone")
    assert not c.throttled and c.postponed
    for bad in ("nonsense", "max-load=a"):
        with pytest.raises(ValueError):
            c(bad)
    with pytest.raises(SystemExit):
        c("panic")


def test_hooks(tmp_path):
    p = tmp_path / "shiftwell-on-success-1"
    p.write_text(f"#!/bin/sh\necho $SHIFTWELL_TABLE > {tmp_path}/out\n")
    p.chmod(p.stat().st_mode | stat.S_IEXEC)
    h = hooks.Composite(hooks.ExecutableHooks(str(tmp_path)), hooks.Hooks())
    h.fire("success", table="t1")
    assert (tmp_path / "out").read_text().strip() == "t1"
    with pytest.raises(ValueError):
        h.on("nothing", print)


def test_metrics_and_config(tmp_path):
    m, sent = metrics.Metrics(tags={"t": "x"}), []
    m.add_sink(lambda *a: sent.append(a))
    m.gauge("a", 2), m.count("b")
    with m.timed("c"):
        pass
    assert [(k, n) for k, n, _, _ in sent] == [("gauge", "shiftwell.a"), ("count", "shiftwell.b"), ("histogram", "shiftwell.c")]
    (tmp_path / "c.ini").write_text("[client]\nuser=${WHO}\npassword=p%q\n[osc]\nmax_load=a=1\n")
    assert read_config(str(tmp_path / "c.ini"), {"WHO": "me"}) == {"client": {"user": "me", "password": "p%q"}, "osc": {"max_load": "a=1"}}
    assert hint_id("state") == 2 and hint_id("note") == 256 and hint_id("note", 300) == 301


def test_charsets(spark):
    df = spark.createDataFrame([(bytes([0x63, 0xE9, 0x80]), "汉字".encode("gbk"))], "l binary, g binary")
    assert tuple(df.select(conv.decode_text(F.col("l"), "latin1"), conv.decode_text(F.col("g"), "gbk")).first()) == ("cé€", "汉字")
    assert df.select(conv.decode_text(F.col("l"), None)).first()[0] == bytearray([0x63, 0xE9, 0x80])
    assert spark.sql("select 1").select(conv.json_text(F.lit('{"b": 1, "a": 2}'), canonical=True)).first()[0] == '{"a":2,"b":1}'


def test_datetimes_are_instants_in_any_session(spark):
    """A DATETIME of Tokyo is the same instant whatever the session's zone is."""
    from shiftwell.spec import Column

    src, to = Column("t", T.TimestampNTZType(), timezone="Asia/Tokyo"), Column("t", T.TimestampType())
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 11:30:00.250000' AS t UNION ALL SELECT TIMESTAMP_NTZ '1969-12-31 23:59:59' UNION ALL SELECT NULL")
            got = sorted((r[0] for r in df.select(F.unix_micros(conv.convert(F.col("t"), src, to))).collect()), key=str)
            assert got == sorted([1710037800250000, -32401000000, None], key=str)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_statsd():
    import socket

    box = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    box.bind(("127.0.0.1", 0))
    box.settimeout(5)
    m = metrics.Metrics(tags={"table": "t"})
    m.add_sink(metrics.statsd_sink("127.0.0.1", box.getsockname()[1]))
    m.gauge("row_copy.rows", 5), m.count("x", 2)
    assert {box.recv(999), box.recv(999)} == {b"shiftwell.row_copy.rows:5|g|#table:t", b"shiftwell.x:2|c|#table:t"}


def test_control_table_keeps_what_counts(spark, tmp_path):
    """Writes beyond ``keep`` are put together: the last value of each hint, and all sentinels."""
    from shiftwell.sources.control import ControlTable, heartbeat_lag, latest
    from shiftwell.sources.store import TableStore

    c = ControlTable(TableStore(spark, str(tmp_path), "_t_ghc"), keep=3)
    for k in range(5):
        c.write("heartbeat", f"2024-01-01T00:00:0{k}Z")
    c.write("drained", "me", seq=17)
    c.write("note", "a"), c.write("state", "copying")
    got = {r.hint: r.value for r in latest(c.read()).collect()}
    assert got == {"heartbeat": "2024-01-01T00:00:04Z", "drained": "me", "note": "a", "state": "copying"} and c.read().count() <= 6
    assert heartbeat_lag(c.read(), F.lit("2024-01-01T00:00:06.5Z")).first()[0] == 2.5 and c.read().where("hint = 'drained'").first().seq == 17


def test_row_estimate(spark, tmp_path):
    from shiftwell.operators import checks

    spark.sql("CREATE TABLE est_t USING parquet AS SELECT id FROM range(70)")
    try:
        assert checks.row_estimate(spark.table("est_t")) is None or checks.row_estimate(spark.table("est_t")) == 70
        spark.sql("ANALYZE TABLE est_t COMPUTE STATISTICS")
        assert checks.row_estimate(spark.table("est_t")) == 70
    finally:
        spark.sql("DROP TABLE est_t")
