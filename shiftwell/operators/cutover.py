"""Cut-over in a Spark catalog, for tables that are read by name instead of through a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..spec import quoted


def exists(spark: SparkSession, name: str) -> bool:
    """By exact name: no character is a wildcard."""
    return spark.catalog.tableExists(name)


def prepare(spark: SparkSession, name: str, drop: bool = False) -> None:
    """Refuse, or drop, a table that stands where a helper table will."""
    if exists(spark, name):
        if not drop:
            raise ValueError(f"table {name} exists already")
        spark.sql(f"DROP TABLE IF EXISTS {quoted(name)}")


def swap_view(spark: SparkSession, view: str, table: str) -> None:
    """Readers of the view see the table from now on; one statement, no time between."""
    spark.sql(f"CREATE OR REPLACE VIEW {quoted(view)} AS SELECT * FROM {quoted(table)}")


def swap_two_step(spark: SparkSession, table: str, new: str, old: str) -> None:
    """table becomes old, then new becomes table; the name is missing in between, and comes back if the second step fails."""
    spark.sql(f"ALTER TABLE {quoted(table)} RENAME TO {quoted(old)}")
    try:
        spark.sql(f"ALTER TABLE {quoted(new)} RENAME TO {quoted(table)}")
    except Exception:
        spark.sql(f"ALTER TABLE {quoted(old)} RENAME TO {quoted(table)}")
        raise


def roll_back(spark: SparkSession, table: str, new: str, old: str) -> None:
    """Undo a two-step swap."""
    spark.sql(f"ALTER TABLE {quoted(table)} RENAME TO {quoted(new)}")
    spark.sql(f"ALTER TABLE {quoted(old)} RENAME TO {quoted(table)}")


def analyze(spark: SparkSession, name: str) -> int:
    """Gather statistics before a swap, and fail if there are none after; the number of rows."""
    spark.sql(f"ANALYZE TABLE {quoted(name)} COMPUTE STATISTICS")
    said = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {quoted(name)}").collect()}
    if "rows" not in said.get("Statistics", ""):
        raise RuntimeError(f"no statistics of {name}")
    return int(said["Statistics"].split(",")[-1].split()[0])


def gate(lag_millis: int, max_lag_millis: int, lock_timeout_millis: int, postponed: bool, throttled: str | None) -> str | None:
    """Why a cut-over should wait, or None."""
    if throttled:
        return f"throttled: {throttled}"
    if lag_millis > min(max_lag_millis, lock_timeout_millis):
        return f"lag={lag_millis / 1000:.3f}s"
    return "postponed" if postponed else None


def same_schema(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns that differ in name, order or type between two tables."""
    a, b = ([(f.name, f.dataType.simpleString()) for f in d.schema] for d in (left, right))
    return [f"{x} / {y}" for x, y in zip([*a, *[None] * (len(b) - len(a))], [*b, *[None] * (len(a) - len(b))], strict=True) if x != y]
