"""Folding a log equals applying it one by one."""

from __future__ import annotations

import random

import pytest

from shiftwell.operators import cdc


def one_by_one(base: dict, events: list) -> dict:
    t = dict(base)
    for _, _, op, k, v in sorted(events):
        if op == "I":
            t.setdefault(k, v)
        elif op == "U":
            if k in t:
                t[k] = v
        else:
            t.pop(k, None)
    return t


@pytest.mark.parametrize("seed", range(6))
def test_fold_is_exact(spark, seed):
    rng = random.Random(seed)
    base = {k: -k for k in range(0, 40, 2)}
    ev = [(s, rng.randrange(2), rng.choice("IUUD"), rng.randrange(40), s) for s in range(400)]
    ev += [(1000 + s, 0, rng.choice("IUD"), 7, s) for s in range(200)]  # a hot key
    b = spark.createDataFrame(list(base.items()), "k int, v int")
    e = spark.createDataFrame(ev, "seq long, sub_seq long, op string, k int, v int")
    want = one_by_one(base, ev)
    for span in (1, 7, 64, cdc.SPAN):
        got = {r["k"]: r["v"] for r in cdc.merge(b, cdc.fold(e, ["k"], ["v"], span), ["k"], ["v"]).collect()}
        assert got == want
    assert cdc.effective_delta(b, e, ["k"]).first()[0] == len(want) - len(base)


def test_raw_events_are_not_shuffled(spark, tmp_path):
    """Each exchange stands above an aggregate: what is shuffled are states of a key over a range, also for a key of half the log."""
    n = 200_000
    spark.range(n).selectExpr("id as seq", "0L as sub_seq", "case when id % 1000 = 7 then 'D' when id % 1000 = 8 then 'I' else 'U' end as op", "if(id % 2 = 0, 0, id % 97) as k", "id as v").write.parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    plan = cdc.fold(e, ["k"], ["v"], 10_000)._jdf.queryExecution().executedPlan().toString().split("\n")
    exchanges = [i for i, line in enumerate(plan) if "Exchange hashpartitioning" in line]
    assert exchanges and all("Aggregate" in plan[i + 1] or "Aggregate" in plan[i + 2] for i in exchanges) and not any("Join" in line for line in plan)
    got = {r.k: r.upd_v for r in cdc.fold(e, ["k"], ["v"], 10_000).where("k = 0").collect()}
    assert got == {0: n - 2}


def test_empty_sides(spark):
    b = spark.createDataFrame([], "k int, v int")
    e = spark.createDataFrame([], "seq long, sub_seq long, op string, k int, v int")
    assert cdc.apply_log(b, e, ["k"], ["v"]).count() == 0
    assert cdc.effective_delta(b, e, ["k"]).first()[0] == 0 and cdc.nominal_delta(e).first()[0] == 0


def test_key_update_moves_a_row(spark):
    e = spark.createDataFrame([(1, 0, "U", (1, "a"), (5, "b")), (2, 0, "U", (5, "b"), (5, "c"))], "seq long, sub_seq long, op string, before struct<k:int,v:string>, after struct<k:int,v:string>")
    s = cdc.split_key_updates(e, ["k"], ["v"])
    assert [(r["op"], r["k"]) for r in s.orderBy("seq", "sub_seq").collect()] == [("D", 1), ("I", 5), ("U", 5)]
    b = spark.createDataFrame([(1, "a")], "k int, v string")
    assert [tuple(r) for r in cdc.apply_log(b, s, ["k"], ["v"]).collect()] == [(5, "c")]


def test_op_names(spark):
    df = spark.createDataFrame([("WriteRowsEventV2",), ("update t set",), ("DELETE",), ("XIDEvent",), ("REPLACE into t",), ("updates",)], "k string")
    assert [r[0] for r in df.select(cdc.event_op(df.k)).collect()] == ["I", "U", "D", "NotDML", "NotDML", "NotDML"]
    e = spark.createDataFrame([(1, 0, "NotDML", (1, "a"), (1, "b"))], "seq long, sub_seq long, op string, before struct<k:int,v:string>, after struct<k:int,v:string>")
    with pytest.raises(Exception, match="unknown event"):
        cdc.split_key_updates(e, ["k"], ["v"]).collect()
