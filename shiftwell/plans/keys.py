"""Unique keys: ranking candidates, keys that both tables share, and shared columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import TableSpec, UniqueKey
from .alter import Alter


def rank_keys(columns: DataFrame, statistics: DataFrame) -> DataFrame:
    """Unique keys in order of preference, from catalog rows.

    columns: table_name, column_name, data_type, charset, extra.  statistics:
    table_name, index_name, seq, column_name, nullable (YES or not), one row
    for each column of a unique index.  Preferred: the primary key, then keys
    that can't be null, without a charset, of a small integer type, of few columns.
    """
    ordered = F.sort_array(F.collect_list(F.struct("seq", "column_name")))
    keys = statistics.groupBy("table_name", "index_name").agg(
        F.count("*").alias("n_columns"), F.array_join(F.transform(ordered, lambda x: x["column_name"]), ",").alias("column_names"),
        F.bool_or(F.col("nullable") == "YES").alias("has_nullable"),
    )
    keys = keys.withColumn("column_name", F.substring_index("column_names", ",", 1))
    own = columns.select("table_name", "column_name", "data_type", F.coalesce("charset", F.lit("")).alias("charset"), F.contains(F.lower("extra"), F.lit("auto_increment")).alias("is_auto_increment"))
    size = F.when(F.col("data_type") == "tinyint", 0).when(F.col("data_type") == "smallint", 1).when(F.col("data_type") == "int", 2).when(F.col("data_type") == "bigint", 3).otherwise(100)
    scored = own.join(keys, ["table_name", "column_name"]).select(
        "table_name", "index_name", "column_names", "n_columns", "has_nullable", "is_auto_increment",
        F.struct(F.col("index_name") != "PRIMARY", F.col("has_nullable"), F.col("charset") != "", size, F.col("n_columns"), F.col("index_name")).alias("_order"),
    )
    better = F.row_number().over(_by_table())
    return scored.withColumn("preference", better.cast("long")).drop("_order")


def _by_table():
    from pyspark.sql import Window

    return Window.partitionBy("table_name").orderBy("_order")  # a table has few keys


def shared_keys(source: TableSpec, target: TableSpec, alter: Alter) -> list[tuple[UniqueKey, UniqueKey]]:
    """Keys of the source, each with the first key of the target whose columns hold all of its own."""
    renamed, out = alter.real_renames(), []
    for key in source.keys:
        names = {renamed.get(c, c) for c in key.columns}
        for other in target.keys:
            if names <= set(other.columns):
                out.append((key, other))
                break
    return out


def shared_keys_frame(source: DataFrame, target: DataFrame) -> DataFrame:
    """The same for keys as rows (name, columns: array)."""
    t = target.select(F.col("name").alias("target_name"), F.col("columns").alias("target_columns"), F.col("ord").alias("target_ord"))
    match = F.size(F.array_except("columns", "target_columns")) == 0
    hit = source.join(F.broadcast(t), match, "inner")  # catalog rows: as many as a table has keys
    return hit.groupBy("name").agg(F.min_by("target_name", "target_ord").alias("target_name"))


def shared_columns(source: TableSpec, target: TableSpec, alter: Alter, skip_renames: bool = False) -> list[tuple[str, str]]:
    """(source, target) names of the columns that both have, in the source's order; generated columns are left out."""
    renamed = {} if skip_renames else alter.real_renames()
    dropped = {d.lower() for d in alter.dropped()}  # also if a column of that name is added again
    new_names = {b.lower() for b in renamed.values()}
    by_name = {c.name.lower(): c for c in target.columns}
    out = []
    for c in source.columns:
        name = renamed.get(c.name, c.name)
        other = by_name.get(name.lower())
        if c.generated or other is None or other.generated or c.name.lower() in dropped or (name == c.name and name.lower() in new_names):
            continue
        out.append((c.name, other.name))
    return out


def usable(spec: TableSpec, key: UniqueKey, allow_nullable: bool = False) -> str | None:
    """Why a key can't order the copy, or None."""
    for name in key.columns:
        c = spec.column(name)
        if c.approximate or isinstance(c.type, T.FloatType):
            return f"{name} is a float"
        if c.json:
            return f"{name} is JSON"
    if key.nullable and not allow_nullable:
        return f"{key.name} can be null"
    return None


def choose_key(source: TableSpec, target: TableSpec, alter: Alter, allow_nullable: bool = False) -> tuple[UniqueKey, UniqueKey]:
    """The first shared key that can be used; says why if there is none."""
    if not source.keys:
        raise ValueError("the table has no primary or unique key")
    if not target.keys:
        raise ValueError("the target has no primary or unique key")
    found = shared_keys(source, target, alter)
    if not found:
        raise ValueError("no unique key is shared after the change")
    reasons = []
    for key, other in found:
        why = usable(source, key, allow_nullable) or usable(target, other, allow_nullable)
        if why is None:
            for c in key.columns:
                t = target.column(alter.real_renames().get(c, c))
                if isinstance(source.column(c).type, T.TimestampNTZType) and isinstance(t.type, T.TimestampType):
                    raise ValueError(f"{c} changes from DATETIME to TIMESTAMP and is part of the key")
            return key, other
        reasons.append(why)
    raise ValueError("no shared key can be used: " + "; ".join(reasons))
