"""Validation: keys, constraints of the target, foreign keys and equality of tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import TableSpec


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))


def row_estimate(df: DataFrame) -> int | None:
    """Rows by the statistics of the catalog (ANALYZE TABLE), without a job; None where none were gathered."""
    conf, name = df.sparkSession.conf, "spark.sql.cbo.planStats.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        count = df.select("*")._jdf.queryExecution().optimizedPlan().stats().rowCount()
        return int(str(count.get())) if count.isDefined() else None
    finally:
        conf.set(name, before)


def null_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: rows with a null in the key (they would never be copied)."""
    some = reduce(Column.__or__, (F.col(k).isNull() for k in key))
    return df.agg(F.count_if(some).alias("n_null_keys"))


def duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values of a new unique key that come more than once; rows with a null in it never conflict."""
    known = reduce(Column.__and__, (F.col(c).isNotNull() for c in columns))
    return df.where(known).groupBy(*columns).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def truncations(df: DataFrame, lengths: dict[str, int]) -> DataFrame:
    """One row: values longer than the target's columns (cut_<column>)."""
    return df.agg(*(F.count_if(F.length(c) > n).alias(f"cut_{c}") for c, n in lengths.items()))


def warnings(df: DataFrame, target: TableSpec, key: Sequence[str]) -> list[str]:
    """What the target's constraints would report of target-shaped rows; duplicates of the migration key are none."""
    out = []
    lengths = {c.name: c.max_length for c in target.columns if c.max_length}
    cut = {}
    if lengths:
        cut = truncations(df, lengths).first().asDict()
        out += [f"Data truncated for column '{c}': {n} rows" for c, n in ((c, cut[f"cut_{c}"]) for c in lengths) if n]
    shortened = df.withColumns({c: F.substring(c, 1, n) for c, n in lengths.items() if cut.get(f"cut_{c}")})
    for k in target.keys:
        if tuple(k.columns) != tuple(key) and (bad := duplicates(shortened, k.columns).first()) is not None:
            out.append(f"Duplicate entry {'-'.join(str(bad[c]) for c in k.columns)!r} for key '{k.name}'")
    missing = [c.name for c in target.columns if not c.nullable and not c.generated]
    if missing:
        n = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in missing)).first()
        out += [f"Column '{c}' cannot be null: {n[c]} rows" for c in missing if n[c]]
    return out


def batch_warnings(table: DataFrame, events: DataFrame, target: TableSpec, key: Sequence[str]) -> list[str]:
    """What the target's constraints would report while a batch of events is applied, in the middle of it too.

    Each event's row is checked, not only the last of its key; a value of
    another unique key is a conflict if two keys of the migration hold it at
    one time: in the table and in an insert or update, or in two of them,
    unless the earlier holder was deleted or changed before.
    """
    rows = events.where("op <> 'D'")
    out = warnings(rows.withColumn("_at", F.struct("seq", "sub_seq")), target.with_columns(target.columns, []), key)
    for k in target.keys:
        if tuple(k.columns) == tuple(key) or not set(k.columns) <= set(table.columns):
            continue
        value = F.struct(*k.columns)
        known = reduce(Column.__and__, (F.col(c).isNotNull() for c in k.columns))
        # every version of the touched rows, with the time that it holds its value
        first = table.join(events.select(*key).distinct(), list(key), "left_semi").select(*key, *k.columns, F.lit(-1).cast("long").alias("seq"), F.lit(0).cast("long").alias("sub_seq"), F.lit("I").alias("op"))
        versions = first.unionByName(events.select(*key, *k.columns, "seq", "sub_seq", "op"))
        until = F.lead(F.struct("seq", "sub_seq")).over(Window.partitionBy(*key).orderBy("seq", "sub_seq"))
        held = versions.withColumn("until", until).where("op <> 'D'").where(known).select(*key, value.alias("value"), F.struct("seq", "sub_seq").alias("since"), "until")
        still = table.join(events.select(*key).distinct(), list(key), "left_anti").where(known).select(*key, value.alias("value"), F.struct(F.lit(-1).cast("long").alias("seq"), F.lit(0).cast("long").alias("sub_seq")).alias("since"), F.lit(None).cast("struct<seq: bigint, sub_seq: bigint>").alias("until"))
        both = held.unionByName(still.join(held.select("value").distinct(), "value", "left_semi"))
        # holders of a value in the order of time: one that comes before all earlier ones of other keys have left conflicts
        order = Window.partitionBy("value").orderBy("since").rowsBetween(Window.unboundedPreceding, -1)
        last = F.max(F.struct(F.coalesce("until", F.struct(F.lit((1 << 62)).alias("seq"), F.lit(0).cast("long").alias("sub_seq"))).alias("u"), F.struct(*key).alias("k"))).over(order)
        bad = both.withColumn("last", last).where((F.col("last.u") > F.col("since")) & (F.col("last.k") != F.struct(*key))).select("value").first()
        if bad is not None:
            out.append(f"Duplicate entry {'-'.join(str(x) for x in bad.value)!r} for key '{k.name}'")
    return out


def foreign_key_counts(references: DataFrame, table: str) -> DataFrame:
    """One row: foreign keys in which the table is the child, and the parent.  references: table_name, referenced_table_name."""
    return references.agg(
        F.coalesce(F.sum(F.when(F.col("table_name") == table, 1).otherwise(0)), F.lit(0)).cast("long").alias("n_child"),
        F.coalesce(F.sum(F.when(F.col("referenced_table_name") == table, 1).otherwise(0)), F.lit(0)).cast("long").alias("n_parent"),
    )


def validate(spec: TableSpec, discard_foreign_keys: bool = False, include_triggers: bool = False) -> None:
    """Refuse what can't be migrated."""
    if spec.foreign_keys_parent:
        raise ValueError("parent-side foreign keys are not supported")
    if spec.foreign_keys_child and not discard_foreign_keys:
        raise ValueError("child-side foreign keys are not supported")
    if spec.triggers and not include_triggers:
        raise ValueError("the table has triggers")


def checksum(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row that two tables of equal rows share, whatever their order: count, sum and xor of row hashes."""
    h = F.xxhash64(*(columns or df.columns))
    return df.agg(F.count("*").alias("n_rows"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))


def same_rows(left: DataFrame, right: DataFrame, left_columns: Sequence[str], right_columns: Sequence[str]) -> DataFrame:
    """One row: equal (boolean), n_left, n_right."""
    a = checksum(left, left_columns).select(F.lit(1).alias("_k"), F.col("n_rows").alias("n_left"), F.struct("*").alias("_a"))
    b = checksum(right, right_columns).select(F.lit(1).alias("_k"), F.col("n_rows").alias("n_right"), F.struct("*").alias("_b"))
    return a.join(b, "_k").select(F.col("_a").eqNullSafe(F.col("_b")).alias("equal"), "n_left", "n_right")
