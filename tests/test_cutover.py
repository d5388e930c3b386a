"""Swaps in a catalog, batches, reconnects."""

from __future__ import annotations

import pytest

from shiftwell.operators import cutover
from shiftwell.streaming.batching import batches, check_position, reconnect


def test_catalog_swaps(spark):
    for n, v in (("co_t", 1), ("co_new", 2)):
        spark.sql(f"DROP TABLE IF EXISTS {n}")
        spark.sql(f"CREATE TABLE {n} USING parquet AS SELECT {v} AS v")
    assert cutover.analyze(spark, "co_new") == 1
    cutover.swap_two_step(spark, "co_t", "co_new", "co_old")
    assert spark.table("co_t").first().v == 2 and spark.table("co_old").first().v == 1
    cutover.roll_back(spark, "co_t", "co_new", "co_old")
    assert spark.table("co_t").first().v == 1 and cutover.exists(spark, "co_new")
    with pytest.raises(Exception, match="co_none"):
        cutover.swap_two_step(spark, "co_t", "co_none", "co_old")
    assert spark.table("co_t").first().v == 1
    cutover.swap_view(spark, "co_view", "co_t")
    cutover.swap_view(spark, "co_view", "co_new")
    assert spark.table("co_view").first().v == 2
    with pytest.raises(ValueError, match="exists"):
        cutover.prepare(spark, "co_new")
    spark.sql("DROP VIEW co_view")
    cutover.prepare(spark, "co_new", drop=True)
    assert not cutover.exists(spark, "co_new")
    assert cutover.same_schema(spark.table("co_t"), spark.range(1)) and not cutover.same_schema(spark.range(2), spark.range(1))


def test_gate():
    assert cutover.gate(100, 1500, 3000, False, None) is None and cutover.gate(1600, 1500, 3000, False, None) == "lag=1.600s"
    assert cutover.gate(0, 1500, 3000, True, None) == "postponed" and cutover.gate(0, 1500, 3000, True, "http=500") == "throttled: http=500"


def test_batches():
    entries = [1, 2, 3, "c", 4, "c", "c", 5]
    assert list(batches(entries, 2, lambda e: e != "c")) == [([1, 2], None), ([3], "c"), ([4], "c"), ([], "c"), ([5], None)]
    with pytest.raises(OverflowError):
        check_position(2**32 - 10, 11)


def test_reconnect():
    log, seen, broken = [(i, f"e{i}") for i in range(1, 6)], [], [3, 5]

    def connect(at):
        for p, e in log:
            if p > at:
                if broken and p == broken[0]:
                    broken.pop(0)
                    raise ConnectionError("lost")
                yield p, e

    assert reconnect(connect, 0, seen.append, 2) == 5 and seen == [e for _, e in log]

    def never(at):
        raise ConnectionError("down")

    with pytest.raises(ConnectionError):
        reconnect(never, 0, seen.append, 3)
