"""Queries that take whole tables, against plain versions over keys that a cut by key would lose."""

from __future__ import annotations

from shiftwell import queries as q


def test_insert_ignore_takes_all_keys(spark, tmp_path):
    lines = [(k, n, 10 * k + n + i, 50.0 if k % 3 == 0 and i else 5.0) for k in (1, 2, 3, 2000, 2001, 9000, 9001, 10**9) for n in (1, 2) for i in (1, 0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    there = {(k, n) for k, n, _, quantity in lines if quantity > 45}
    want = {}
    for k, n, part, _ in lines:
        if (k, n) not in there:
            want[k, n] = min(part, want.get((k, n), part))
    got = [tuple(r) for r in q.QUERIES["insert_ignore_whole_table"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((k, n, part) for (k, n), part in want.items()) and max(got)[0] == 10**9


def test_copy_takes_the_whole_table(spark, tmp_path):
    spark.createDataFrame([(k, k, 1.0) for k in (1, 3, 100, 1000, 1001, 10**9)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(r[0] for r in q.QUERIES["copy_whole_table"](spark, str(tmp_path)).collect()) == [1, 100, 1000, 1001, 10**9]


def test_split_takes_all_kinds(spark, tmp_path):
    spark.createDataFrame([(1, "signup", 7, 1.0), (2, "click", 7, 2.0), (5, "view", 7, 3.0), (10, "error", 7, 4.0)], "event_id long, event_type string, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.seq, r.sub_seq, r.op, r.user_id) for r in q.QUERIES["cdc_split_whole_log"](spark, str(tmp_path)).collect())
    assert got == [(1, 0, "I", 7), (2, 0, "U", 7), (5, 0, "D", 7), (5, 1, "I", 1_000_007), (10, 0, "D", 7)]
