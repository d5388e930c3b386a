"""Key ranges, chunk ends and whole chunk plans of a table in key order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..runtime import cut
from .predicates import lexicographic, union_ranges


def key_bounds(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: the least and the greatest key tuple (min_<column>, max_<column>); none for an empty table."""
    tup = F.struct(*key)
    known = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in key))
    ends = known.agg(F.min(tup).alias("lo"), F.max(tup).alias("hi")).where("lo IS NOT NULL")
    return ends.select(*(F.col(f"lo.{k}").alias(f"min_{k}") for k in key), *(F.col(f"hi.{k}").alias(f"max_{k}") for k in key))


def _open(df: DataFrame, key: Sequence[str], start: Sequence, stop: Sequence, inclusive: bool) -> DataFrame:
    return df.where(lexicographic(key, start, ">=" if inclusive else ">", df.schema) & lexicographic(key, stop, "<=", df.schema)).select(*key)


def chunk_end_by_offset(df: DataFrame, key: Sequence[str], start: Sequence, stop: Sequence, size: int, inclusive: bool = False) -> DataFrame:
    """The size-th key after start, up to stop; no row if fewer are left."""
    return _open(df, key, start, stop, inclusive).orderBy(*key).offset(size - 1).limit(1)


def chunk_end_of_rest(df: DataFrame, key: Sequence[str], start: Sequence, stop: Sequence, size: int, inclusive: bool = False) -> DataFrame:
    """The last of the first ``size`` keys after start."""
    return _open(df, key, start, stop, inclusive).orderBy(*key).limit(size).orderBy(*(F.desc(k) for k in key)).limit(1)


def chunk_end_of_union(df: DataFrame, key: Sequence[str], start: Sequence, stop: Sequence, size: int, inclusive: bool = False) -> DataFrame:
    """As chunk_end_by_offset for a key of two columns, over the union of its disjoint ranges."""
    return union_ranges(df, key, start, stop, inclusive).select(*key).orderBy(*key).offset(size - 1).limit(1)


def next_chunk_end(df: DataFrame, key: Sequence[str], start: Sequence, stop: Sequence, size: int, inclusive: bool = False) -> Row | None:
    """Where the chunk after start ends; None when nothing is left."""
    for f in (chunk_end_by_offset, chunk_end_of_rest):
        if rows := f(df, key, start, stop, size, inclusive).collect():  # one row
            return rows[0]
    return None


def plan_chunks(df: DataFrame, key: Sequence[str], size: int, partitions: int | None = None) -> DataFrame:
    """All chunks in one pass: chunk_id, n_rows, min_<column>, max_<column>.

    Keys are range-partitioned and sorted; a row's place is its partition's
    offset plus its place within it, so that nothing goes through one task.
    The sampled ranges are fixed by a checkpoint before they are counted.
    """
    spark = df.sparkSession
    n = partitions or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = df.select(*key).repartitionByRange(n, *key).sortWithinPartitions(*key)
    placed = cut(keys.select(*key, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_i")))
    counts = {r["_p"]: r["count"] for r in placed.groupBy("_p").count().collect()}  # a row for each partition
    offsets, total = {}, 0
    for p in sorted(counts):
        offsets[p], total = total, total + counts[p]
    at = F.create_map(*(x for p, o in offsets.items() for x in (F.lit(p), F.lit(o).cast("long")))) if offsets else F.create_map(F.lit(0), F.lit(0).cast("long"))
    ranked = placed.withColumn("chunk_id", F.floor((F.element_at(at, F.col("_p")) + F.col("_i")) / size).cast("long"))
    tup = F.struct(*key)
    out = ranked.groupBy("chunk_id").agg(F.count("*").alias("n_rows"), F.min(tup).alias("lo"), F.max(tup).alias("hi"))
    return out.select("chunk_id", "n_rows", *(F.col(f"lo.{k}").alias(f"min_{k}") for k in key), *(F.col(f"hi.{k}").alias(f"max_{k}") for k in key))
