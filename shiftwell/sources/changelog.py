"""The change log as a stream or as rows: one file source, read in order of (seq, sub_seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_schema(key_and_values: list[T.StructField]) -> T.StructType:
    """seq, sub_seq, db, table, op, before, after."""
    image = T.StructType(key_and_values)
    return T.StructType([
        T.StructField("seq", T.LongType(), False), T.StructField("sub_seq", T.LongType(), False), T.StructField("db", T.StringType()), T.StructField("table", T.StringType()),
        T.StructField("op", T.StringType()), T.StructField("before", image), T.StructField("after", image),
    ])


def read_log(spark: SparkSession, path: str, schema: T.StructType, after: int | None = None) -> DataFrame:
    """Events after a position, as rows."""
    df = spark.read.schema(schema).parquet(path)
    return df if after is None else df.where(F.col("seq") > after)


def stream_log(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 10, after: int | None = None) -> DataFrame:
    """Events (after a position) as a stream, with the file that each comes from; bounded micro-batches hold the backlog back."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).select("*", F.col("_metadata.file_path").alias("file"))
    return df if after is None else df.where(F.col("seq") > after)


def file_bounds(spark: SparkSession, path: str, schema: T.StructType, after: int | None = None) -> DataFrame:
    """(file, low, high): the least and the greatest position (after one) of each file of a log."""
    return read_log(spark, path, schema, after).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("seq").alias("low"), F.max("seq").alias("high"))


def position(log: DataFrame) -> int | None:
    """The current end of a log."""
    return log.agg(F.max("seq")).first()[0]
