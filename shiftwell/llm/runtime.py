"""Session helpers of the training-data operators: shared storage, shipping, held-out splits."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_STORED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; an own one only where it is unset and all runs on this machine (tests)."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="shiftwell-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut at a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again; deleted by ``clear``, at the end of the program at the latest."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    if not _STORED:
        atexit.unregister(clear)
        atexit.register(clear, spark)
    _STORED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch: texts are long, and a batch lies in memory on both sides.
BATCH_ROWS = 2000


def clear(spark: SparkSession, keep: int = 0) -> None:
    """Delete what ``stored`` has written (after the first ``keep`` folders), once no result that was made from it is needed any more."""
    while len(_STORED) > keep:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(_STORED.pop())
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except (Py4JError, OSError):  # the JVM is gone
            _STORED.clear()


#: Keys (ids, hashes) that are sent to all executors at most; beyond it they are joined.
SMALL_KEYS = 500_000


def without(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df whose columns ``on`` are not among the keys (distinct, few columns); the texts are not shuffled while the keys are few."""
    return df.join(_sent(keys), on, "left_anti")


def within(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df whose columns ``on`` are among the keys (distinct, few columns)."""
    return df.join(_sent(keys), on, "left_semi")


def _sent(keys: DataFrame) -> DataFrame:
    keys = stored(keys)
    return F.broadcast(keys) if keys.count() <= SMALL_KEYS else keys


def scratch() -> str:
    """A folder on the driver for a file that Spark ships; gone at the end of the program."""
    at = tempfile.mkdtemp(prefix="shiftwell-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application.

    These operators need small Arrow batches, as texts are long: a session that
    leaves spark.sql.execution.arrow.maxRecordsPerBatch at its default gets BATCH_ROWS.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows, "10000") == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    if str(root) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    at = Path(scratch()) / "shiftwell_src.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted((root / "shiftwell").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(at))


def remainder(doc_id: str, k: int) -> Column:
    """crc32 of the id as text (a null id: of the empty text), modulo k."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(k))


def sampled(df: DataFrame, key: list[str], limit: int) -> DataFrame:
    """About ``limit`` rows of df, all if it has no more: those whose key's hash is below a threshold, so that nothing is sorted or gathered."""
    n = df.count()
    if n <= limit:
        return df
    return df.where(F.pmod(F.xxhash64(*(F.col(k).cast("string") if k == "doc_id" else F.col(k) for k in key), F.lit("sample" if len(key) == 1 else "row")), F.lit(1 << 30)) < int((1 << 30) * limit / n))


def learnable(rows: DataFrame, y: DataFrame, limit: int) -> DataFrame:
    """Rows (doc_id, stats) with their labels y: about ``limit`` distinct ones, however many rows an id has."""
    found = cut(rows.join(sampled(y, ["doc_id"], limit), "doc_id").select("doc_id", "stats", "y").distinct())
    return sampled(found, ["doc_id", "stats"], limit)


def labels_of(labels: DataFrame, target: str, rule: Column) -> DataFrame:
    """(doc_id, y) of the labels that may be learnt from; an id with several labels takes their rounded mean."""
    own = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & rule)
    return own.groupBy("doc_id").agg((F.avg(target) >= 0.5).cast("int").alias("y"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
