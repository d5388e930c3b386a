"""Tables as data: columns with their MySQL traits, unique keys, options, and names of helper tables."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

MAX_NAME = 64  # bytes of an identifier


@dataclass(frozen=True)
class Column:
    """A column: Spark type plus what the change log's raw values need to be read."""

    name: str
    type: T.DataType
    nullable: bool = True
    unsigned_bits: int = 0  # 8, 16, 24, 32 or 64
    charset: str | None = None
    enum: tuple[str, ...] = ()
    binary_length: int = 0  # BINARY(n)
    max_length: int = 0  # VARCHAR(n)
    timezone: str | None = None  # DATETIME that becomes TIMESTAMP
    json: bool = False
    approximate: bool = False  # FLOAT
    generated: str | None = None  # SQL of a generated column
    default: str | None = None  # SQL of the default
    auto_increment: bool = False

    def field(self) -> T.StructField:
        traits = {k: v for k, v in (("unsigned_bits", self.unsigned_bits), ("charset", self.charset), ("enum", list(self.enum)), ("binary_length", self.binary_length)) if v}
        return T.StructField(self.name, self.type, self.nullable, traits)


@dataclass(frozen=True)
class UniqueKey:
    name: str
    columns: tuple[str, ...]
    nullable: bool = False
    auto_increment: bool = False


@dataclass(frozen=True)
class TableSpec:
    """A table's columns in order, its unique keys, and what can forbid a migration."""

    name: str
    columns: tuple[Column, ...]
    keys: tuple[UniqueKey, ...] = ()
    foreign_keys_child: int = 0
    foreign_keys_parent: int = 0
    triggers: tuple[str, ...] = ()
    next_id: int | None = None

    def column(self, name: str) -> Column:
        """By exact name: lookup is case-sensitive, other than Spark's."""
        return next(c for c in self.columns if c.name == name)

    def has(self, name: str) -> bool:
        return any(c.name == name for c in self.columns)

    def schema(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns])

    def with_columns(self, columns, keys=None) -> TableSpec:
        return replace(self, columns=tuple(columns), keys=self.keys if keys is None else tuple(keys))

    @classmethod
    def of(cls, name: str, schema: T.StructType, *keys: tuple[str, ...]) -> TableSpec:
        cols = tuple(Column(f.name, f.dataType, f.nullable) for f in schema.fields)
        return cls(name, cols, tuple(UniqueKey("PRIMARY" if not i else f"uk{i}", tuple(k)) for i, k in enumerate(keys)))


@dataclass
class Options:
    """What changes results or the course of a migration; clamped where a range is set."""

    execute: bool = True
    chunk_size: int = 1000
    dml_batch_size: int = 10
    approve_renames: bool = False
    skip_renames: bool = False
    allow_nullable_key: bool = False
    allow_zero_dates: bool = False
    panic_on_warnings: bool = False
    discard_foreign_keys: bool = False
    attempt_instant: bool = False
    include_triggers: bool = False
    exact_rowcount: bool = True
    checkpoint_seconds: float = 300
    ok_to_drop: bool = False
    timestamp_old_table: bool = False
    analyze_before_cutover: bool = False
    two_step_cutover: bool = False
    timezone: str = "UTC"
    max_lag_millis: int = 1500
    nice_ratio: float = 0.0
    max_retries: int = 60
    exponential_backoff_max: int = 64
    heartbeat_millis: int = 100
    max_load: dict = field(default_factory=dict)
    critical_load: dict = field(default_factory=dict)
    critical_load_interval_millis: int = 0  # 0: a critical load ends the run at once
    critical_load_hibernate_seconds: int = 0
    lock_timeout_millis: int = 3000
    write_rows: int = 5_000_000  # of a copy by chunks, written at once
    throttle_flag_file: str = ""
    panic_flag_file: str = ""
    postpone_flag_file: str = ""

    def __post_init__(self):
        clamp = lambda v, lo, hi: max(lo, min(hi, v))
        self.chunk_size = clamp(self.chunk_size, 10, 100_000)
        self.dml_batch_size = clamp(self.dml_batch_size, 1, 1000)
        self.heartbeat_millis = clamp(self.heartbeat_millis, 100, 1000)
        self.checkpoint_seconds = max(10, self.checkpoint_seconds)
        self.nice_ratio = clamp(self.nice_ratio, 0.0, 100.0)
        self.max_lag_millis = max(100, self.max_lag_millis)


def truncated(name: str, limit: int = MAX_NAME) -> str:
    """name cut to ``limit`` bytes of UTF-8, never within a character."""
    return name.encode()[:limit].decode(errors="ignore")


def quoted(name: str) -> str:
    return "`" + name.strip("`").replace("`", "``") + "`"


def helper_name(table: str, kind: str, at: float | None = None, revert: bool = False) -> str:
    """Name of a helper table: new version (gho), old version (del), control (ghc) and checkpoints (ghk)."""
    kind = f"rev_{kind}" if revert and kind == "del" else kind
    stamp = time.strftime("%Y%m%d%H%M%S_", time.gmtime(at)) if at is not None else ""
    suffix = f"_{stamp}{kind}"
    return "_" + truncated(table, MAX_NAME - 1 - len(suffix.encode())) + suffix
