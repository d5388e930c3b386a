"""Ranges, chunk plans, statements, keys and names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

from shiftwell.plans import alter, chunks, keys
from shiftwell.plans.predicates import between, compare, lexicographic, union_ranges
from shiftwell.spec import Column, Options, TableSpec, UniqueKey, helper_name, quoted, truncated


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(5)
    rows = sorted({(rng.randrange(8), rng.randrange(30)) for _ in range(120)})
    return rows, spark.createDataFrame(rows, "a int, b int")


def test_lexicographic_is_tuple_order(pairs):
    rows, df = pairs
    for sign, f in (("<", tuple.__lt__), ("<=", tuple.__le__), (">", tuple.__gt__), (">=", tuple.__ge__)):
        got = {tuple(r) for r in df.where(lexicographic(["a", "b"], [3, 12], sign)).collect()}
        assert got == {r for r in rows if f(r, (3, 12))}


def test_union_equals_range(pairs):
    rows, df = pairs
    for start, end, inc in (((1, 5), (6, 2), False), ((2, 3), (2, 20), True), ((0, 0), (7, 29), True)):
        want = {r for r in rows if (r >= start if inc else r > start) and r <= end}
        assert {tuple(r) for r in union_ranges(df, ["a", "b"], start, end, inc).collect()} == want
        assert {tuple(r) for r in df.where(between(["a", "b"], start, end, inc)).collect()} == want


def test_null_keys_fit_no_range(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (1, 1)], "a int, b int")
    assert df.where(between(["a", "b"], [0, 0], [9, 9], True)).count() == 2  # (1, null) is decided by its first column
    assert df.where(lexicographic(["a", "b"], [1, 5], "<")).count() == 1


@pytest.mark.parametrize("bad", [lambda: compare("", 1, "="), lambda: compare("a", 1, "~"), lambda: lexicographic([], [], "<"), lambda: lexicographic(["a"], [1, 2], "<"), lambda: lexicographic(["a"], [1], "=")])
def test_bad_comparisons(spark, bad):
    with pytest.raises(ValueError):
        bad()


def test_chunk_plan_equals_iteration(pairs, spark):
    rows, df = pairs
    plan = {r["chunk_id"]: ((r["min_a"], r["min_b"]), (r["max_a"], r["max_b"]), r["n_rows"]) for r in chunks.plan_chunks(df, ["a", "b"], 17).collect()}
    assert [plan[k] for k in sorted(plan)] == [(c[0], c[-1], len(c)) for c in (rows[i : i + 17] for i in range(0, len(rows), 17))]
    start, seen, first = rows[0], [], True
    while (end := chunks.next_chunk_end(df, ["a", "b"], start, rows[-1], 17, first)) is not None:
        seen.append(tuple(end))
        start, first = tuple(end), False
        if start == rows[-1]:
            break
    assert seen == [plan[k][1] for k in sorted(plan)]


def test_3421_rows_by_73(spark):
    assert chunks.plan_chunks(spark.range(3421), ["id"], 73).count() == 47


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int")
    assert chunks.key_bounds(df, ["a"]).count() == 0 and chunks.plan_chunks(df, ["a"], 10).count() == 0


def test_statements():
    a = alter.parse("ALTER TABLE `my db`.tbl DROP COLUMN a, CHANGE COLUMN b c int NOT NULL DEFAULT 3 AFTER id, ADD COLUMN d varchar(12) COMMENT 'drop x, change y z'")
    assert (a.schema, a.table) == ("my db", "tbl")
    assert a.dropped() == {"a"} and a.real_renames() == {"b": "c"} and not a.renames_table
    assert [c.kind for c in a.changes] == ["drop", "change", "add"] and a.changes[1].place == "id"
    assert alter.parse("drop bad statement").dropped() == set()
    assert alter.parse("rename as other").renames_table and alter.parse("rename to other").renames_table
    assert not alter.parse("rename column a to b").renames_table and alter.parse("rename column a to b").real_renames() == {"a": "b"}
    assert alter.parse("AUTO_INCREMENT=7").auto_increment == 7 and alter.parse("engine=innodb").auto_increment is None
    assert alter.parse("change a a int").real_renames() == {} and alter.parse("change a a int").renamed() == {"a": "a"}
    assert len(alter.split_clauses("add e enum('a,b','c)'), drop x")) == 2
    assert alter.parse("add column exchange double comment 'exchange rate'").real_renames() == {}


def test_types():
    t = lambda d: alter.read_type("x", d)
    assert t("int unsigned not null").type == T.LongType() and t("bigint unsigned").type == T.DecimalType(20, 0)
    assert t("decimal(65,30)").type == T.StringType() and t("decimal(10,2)").type == T.DecimalType(10, 2)
    assert t("enum('red','it''s')").enum == ("red", "it's") and t("binary(20)").binary_length == 20
    assert t("varchar(32) not null default ''").default == "''" and not t("varchar(32) not null default ''").nullable
    assert t("int as (a + b) virtual").generated == "a + b" and t("float").approximate and t("json").json
    with pytest.raises(ValueError):
        t("nonsense")


def spec(*cols, keys_=(("id",),), **more):
    return TableSpec("t", tuple(c if isinstance(c, Column) else Column(c, T.IntegerType(), False) for c in cols), tuple(UniqueKey("PRIMARY" if not i else f"k{i}", k) for i, k in enumerate(keys_)), **more)


def planned(s, statement):
    a = alter.parse(statement)
    return s, alter.apply_to(s, a), a


def test_shared_columns_and_keys():
    s, t, a = planned(spec("id", "c1", "c2"), "change column c2 c2a int not null after id")
    assert [c.name for c in t.columns] == ["id", "c2a", "c1"]
    assert keys.shared_columns(s, t, a) == [("id", "id"), ("c1", "c1"), ("c2", "c2a")]
    assert keys.choose_key(s, t, a)[0].columns == ("id",)
    s, t, a = planned(spec("id", "i"), "drop primary key, add primary key (id, i)")
    assert keys.choose_key(s, t, a)[1].columns == ("id", "i")
    s, t, a = planned(spec("id", "c1"), "drop column c1, add column c1 int not null default 47")
    assert keys.shared_columns(s, t, a) == [("id", "id")]
    s, t, a = planned(spec("id", "c1"), "change id new_id int not null")
    assert keys.choose_key(s, t, a)[1].columns == ("new_id",)


@pytest.mark.parametrize(("s", "statement", "why"), [
    (spec("id", "i"), "drop primary key, add primary key (i)", "no unique key is shared"),
    (spec("id", "i", keys_=()), "add column v varchar(32)", "no primary or unique key"),
    (spec("id", "i"), "change id id int, drop primary key", "target has no primary"),
    (spec(Column("f", T.FloatType(), False, approximate=True), keys_=(("f",),)), "add column v varchar(32)", "float"),
    (spec("id", Column("t", T.TimestampNTZType(), False), keys_=(("id", "t"),)), "change column t t timestamp not null", "DATETIME to TIMESTAMP"),
])
def test_refused_keys(s, statement, why):
    with pytest.raises(ValueError, match=why):
        keys.choose_key(*planned(s, statement))


def test_instant():
    assert alter.instant(alter.parse("add column x int")) and not alter.instant(alter.parse("rename column a to b")) and not alter.instant(alter.parse("drop column x")) and not alter.instant(alter.parse("add column x int not null default 1"))


def test_names_and_options():
    assert helper_name("sbtest", "gho") == "_sbtest_gho" and helper_name("t", "del", revert=True) == "_t_rev_del"
    assert len(helper_name("x" * 80, "del", at=0).encode()) == 64 and helper_name("x" * 80, "ghc").endswith("_ghc")
    assert truncated("é" * 40, 63) == "é" * 31 and quoted("a`b") == "`a``b`"
    o = Options(chunk_size=1, dml_batch_size=5000, heartbeat_millis=5, checkpoint_seconds=1)
    assert (o.chunk_size, o.dml_batch_size, o.heartbeat_millis, o.checkpoint_seconds) == (10, 1000, 100, 10)
