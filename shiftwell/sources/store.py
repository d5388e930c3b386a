"""Versions of a table: folders of Parquet, one manifest names those that are current.

A manifest is written under its own number and never changed; the table is the
one with the highest number, so that a swap is a single rename in the file
system, and a batch that comes again is recognised by what the manifest says
has been applied.  A manifest lists either folders, or one folder for each
bucket of a key's hash: an apply then rewrites only the buckets that it
touches, an append adds a folder, and a cut-over names another table's folders.

The rename must fail where the name exists, and be atomic: the local file
system, HDFS and ABFS do so.  Object stores without that are refused unless
the caller says that there is only one writer.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemes of file systems whose rename is atomic and fails where the name exists.
ATOMIC = ("file", "hdfs", "viewfs", "abfs", "abfss")
BUCKET = "_bucket"
BUCKET_BYTES, MAX_BUCKETS = 128 << 20, 1 << 16


class TableStore:
    def __init__(self, spark: SparkSession, root: str, name: str, single_writer: bool = False):
        self.spark, self.root, self.at, self.name = spark, root.rstrip("/"), f"{root.rstrip('/')}/{name}", name
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.at).getFileSystem(spark._jsc.hadoopConfiguration())
        if not single_writer and self._fs.getUri().getScheme() not in ATOMIC:
            raise ValueError(f"{self._fs.getUri().getScheme()}: renames may not be atomic here; say single_writer")

    # -- manifests

    def _numbers(self) -> list[int]:
        at = self._path(f"{self.at}/manifest")
        if not self._fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(at) if s.getPath().getName().endswith(".json"))

    def manifest(self) -> dict | None:
        n = self._numbers()
        return self._read(n[-1]) if n else None

    def _read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.at}/manifest/{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def exists(self) -> bool:
        return self.manifest() is not None

    def swap(self, data: list[str] | dict[str, list[str]] | str, **facts) -> dict:
        """Make folders (or folders by bucket) current, with what they hold (applied_seq, batch_id, …); fails if another writer was faster."""
        number = (self._numbers() or [0])[-1] + 1
        body = {"number": number, "data": [data] if isinstance(data, str) else data, **facts}
        draft = self._path(f"{self.at}/manifest/.{uuid.uuid4().hex}.draft")
        stream = self._fs.create(draft)
        stream.write(json.dumps(body).encode())
        stream.close()
        if not self._fs.rename(draft, self._path(f"{self.at}/manifest/{number:012d}.json")):
            self._fs.delete(draft, False)
            raise RuntimeError(f"another writer made version {number} of {self.name}")
        return body

    # -- data

    def folders(self, m: dict | None = None, buckets: Sequence[int] | None = None) -> list[str]:
        """Full paths of a manifest's data, or of some of its buckets."""
        m = m or self.manifest()
        return [f"{self.root}/{p}" for p in _named(m["data"], buckets)]

    def read(self, m: dict | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        m = m or self.manifest()
        if m is None:
            raise FileNotFoundError(f"no table {self.name}")
        paths, schema = self.folders(m, buckets), m.get("schema") and T.StructType.fromJson(m["schema"])
        if m.get("missing"):
            raise FileNotFoundError(f"{self.name} is being swapped")
        if not paths:
            if schema is None:
                raise FileNotFoundError(f"{self.name} has no data and no schema")
            return self.spark.createDataFrame([], schema)
        # with a schema: changed without a rewrite, so that new columns are null in old files
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(*paths)

    def write_version(self, df: DataFrame) -> str:
        """New data that no manifest names yet; its folder."""
        at = f"{self.name}/data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{at}")
        return at

    def bucket_of(self, key: Sequence[str], n: int):
        return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")

    def bucket_count(self) -> int:
        """Buckets of about BUCKET_BYTES for the table's present size."""
        size = sum(self._fs.getContentSummary(self._path(p)).getLength() for p in self.folders())
        return int(min(MAX_BUCKETS, max(4, -(-size // BUCKET_BYTES))))

    def write_buckets(self, df: DataFrame, key: Sequence[str], n: int) -> dict[str, list[str]]:
        """New data by bucket of the key, which no manifest names yet; a bucket without rows has no folder."""
        at = f"{self.name}/data/{uuid.uuid4().hex}"
        # rebalanced: small buckets share a task, large ones are split over several
        df.withColumn(BUCKET, self.bucket_of(key, n)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/{at}")
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{at}")) if s.isDirectory()]
        return {d.split("=")[1]: [f"{at}/{d}"] for d in found if d.startswith(f"{BUCKET}=")}

    def vacuum(self, keep: int = 3) -> int:
        """Forget all but the last ``keep`` manifests, and delete the data that only the forgotten ones name; how many folders went."""
        numbers = self._numbers()
        used = {p for n in numbers[-keep:] for p in _all(self._read(n))}
        gone = 0
        for n in numbers[:-keep]:
            for p in _all(self._read(n)) - used:
                gone += self._fs.delete(self._path(f"{self.root}/{p}"), True)
            self._fs.delete(self._path(f"{self.at}/manifest/{n:012d}.json"), False)
        return gone

    def release(self) -> None:
        """Forget the table; its data stays, as another manifest names it now."""
        self._fs.delete(self._path(f"{self.at}/manifest"), True)

    def drop_data(self, m: dict) -> None:
        for p in _named(m["data"]):
            self._fs.delete(self._path(f"{self.root}/{p}"), True)

    def drop(self) -> None:
        self._fs.delete(self._path(self.at), True)


def _named(data: list[str] | dict[str, list[str]], buckets: Sequence[int] | None = None) -> list[str]:
    """The folders of a manifest's data, or of some buckets."""
    return list(data) if isinstance(data, list) else [p for b, own in data.items() if buckets is None or int(b) in buckets for p in own]


def _all(m: dict) -> set[str]:
    """All folders that a manifest needs: its data, what it holds back, and the version that it replaced."""
    return {*_named(m.get("data") or []), *_named((m.get("old") or {}).get("data") or []), *(h["at"] for h in m.get("held") or [])}


class RunnerLock:
    """One migration of a table at a time: a file that only one creates, and that its owner touches every ``beat`` seconds.

    A lock that has not been touched for ``dead`` seconds belonged to a driver that is gone, and is taken over.
    """

    def __init__(self, store: TableStore, beat: float = 10, dead: float = 60):
        self.store, self.file, self.beat, self.dead = store, store._path(f"{store.at}.lock"), beat, dead
        self._stop = threading.Event()

    def _age(self) -> float:
        return time.time() - self.store._fs.getFileStatus(self.file).getModificationTime() / 1000

    def __enter__(self):
        fs = self.store._fs
        if not fs.createNewFile(self.file):
            if self._age() < self.dead:
                raise RuntimeError(f"{self.store.name} is being migrated already")
            # of several that find it dead, the one that renames it goes on
            if not fs.rename(self.file, self.store._path(f"{self.store.at}.lock-{uuid.uuid4().hex}")) or not fs.createNewFile(self.file):
                raise RuntimeError(f"{self.store.name} is being migrated already")
        self._stop.clear()
        threading.Thread(target=self._keep, daemon=True).start()
        return self

    def _keep(self) -> None:
        while not self._stop.wait(self.beat):
            self.store._fs.setTimes(self.file, int(time.time() * 1000), -1)

    def __exit__(self, *_):
        self._stop.set()
        self.store._fs.delete(self.file, False)
