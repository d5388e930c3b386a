"""Snapshot copy: projection into the target's schema, idempotent against rows that are there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conversions import convert
from ..plans.predicates import between
from ..spec import TableSpec


def project(source: DataFrame, source_spec: TableSpec, target_spec: TableSpec, shared: Sequence[tuple[str, str]], raw: bool = False, **how) -> DataFrame:
    """source's rows in the target's columns: shared ones converted (how: zone, zero_dates), others by default, generated ones computed."""
    names = {t: s for s, t in shared}
    plain = []
    for c in target_spec.columns:
        if c.generated:
            continue
        if c.name in names:
            v: Column = convert(F.col(names[c.name]), source_spec.column(names[c.name]), c, raw, **how)
        elif c.default is not None:
            v = F.expr(c.default).cast(c.type)
        else:
            v = F.lit(None).cast(c.type)
        plain.append(v.alias(c.name))
    out = source.select(*plain)
    for c in target_spec.columns:
        if c.generated:
            out = out.withColumn(c.name, F.expr(c.generated).cast(c.type))
    return out.select(*(c.name for c in target_spec.columns))


def first_by_key(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row for each key: the least one, in the order of all columns; partial sums shrink hot keys before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    if not rest:
        return rows.distinct()
    return rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")).select(*(F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in rows.columns))


def insert_ignore(target: DataFrame, rows: DataFrame, key: Sequence[str], unique_rows: bool = False) -> DataFrame:
    """The rows that an insert adds when rows of a key that is there, or comes twice, are ignored."""
    own = rows if unique_rows else first_by_key(rows, key)
    return own.join(target.select(*key), list(key), "left_anti").select(*rows.columns)


def copy_chunk(source: DataFrame, target: DataFrame, key: Sequence[str], start: Sequence, end: Sequence, inclusive: bool, form) -> DataFrame:
    """What one chunk of the source adds to the target; form maps source rows to target rows with the same key columns."""
    return insert_ignore(target, form(source.where(between(key, start, end, inclusive, source.schema))), key, unique_rows=True)
