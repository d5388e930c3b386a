"""Value conversions between a change log's raw values and Spark's types, all built-in Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import Column as Spec

#: MySQL's names of charsets that Java knows under another one (fixed values).
JAVA_CHARSETS = {"latin1": "windows-1252", "gbk": "GBK", "utf8": "UTF-8", "utf8mb3": "UTF-8", "utf8mb4": "UTF-8", "ascii": "US-ASCII"}


def unsigned(value: Column, bits: int) -> Column:
    """A signed reading of an unsigned column, as its own number; 64 bits become DECIMAL(20,0)."""
    wide = T.DecimalType(20, 0) if bits == 64 else T.LongType()
    v = value.cast(wide)
    return F.when(v < 0, (v + F.lit(str(1 << bits)).cast(wide)).cast(wide)).otherwise(v)


def pad_binary(value: Column, length: int) -> Column:
    """BINARY(n): zero bytes at the end come back; longer values aren't cut."""
    return F.when(F.length(value) < length, F.rpad(value, length, F.lit(b"\0"))).otherwise(value)


def enum_text(index: Column, values: tuple[str, ...]) -> Column:
    """The text of an enum's index from 1 on; null outside."""
    return F.when(index > 0, F.get(F.array(*(F.lit(v) for v in values)), (index - 1).cast("int")))


def decode_text(value: Column, charset: str | None) -> Column:
    """Bytes of a charset to text; without a charset they stay bytes.

    GBK and Windows-1252 need spark.sql.legacy.javaCharsets=true.
    """
    return value if charset is None else F.decode(value, JAVA_CHARSETS.get(charset, charset))


def datetime_to_utc(value: Column, zone: str) -> Column:
    """A DATETIME (no zone) in the writer's zone as the TIMESTAMP it means."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), value.cast("timestamp_ntz"))


def datetime_to_instant(value: Column, zone: str) -> Column:
    """The same as a TIMESTAMP of Spark, an instant: what the session's zone is makes no difference."""
    v = value.cast("timestamp_ntz")
    return F.make_timestamp_ltz(F.year(v), F.month(v), F.day(v), F.hour(v), F.minute(v), F.date_part(F.lit("SECOND"), v), F.lit(zone))


def zero_date(value: Column, strict: bool) -> tuple[Column, Column]:
    """A date text that may have zero parts: its timestamp (null, or an error if strict), and whether it had."""
    odd = F.regexp_like(value, F.lit(r"^0000-|-00")) if isinstance(value, Column) else None
    parsed = value.cast("timestamp_ntz") if strict else value.try_cast("timestamp_ntz")
    return parsed, F.coalesce(odd, F.lit(False))


def json_text(value: Column, canonical: bool = False) -> Column:
    """JSON as it is, or in one form for equal values."""
    return F.to_json(F.parse_json(value)) if canonical else value


def load_map(text: Column) -> Column:
    """'k=v,k=v' as a map of numbers."""
    return F.transform_values(F.str_to_map(text, F.lit(","), F.lit("=")), lambda _, v: v.cast("long"))


def lag_seconds(heartbeat: Column, now: Column) -> Column:
    """Seconds since a heartbeat's time (RFC 3339)."""
    return now.cast("timestamp").cast("double") - heartbeat.cast("timestamp").cast("double")


def convert(value: Column, source: Spec, target: Spec, raw: bool = False, zone: str = "UTC", zero_dates: bool = False) -> Column:
    """A source column's value as the target column's: the one path of copy and replay.

    ``raw``: the value comes from the change log as it was written (signed
    numbers, enum indices, bytes); otherwise it is a value of the table.
    zone: of DATETIME columns without one of their own.  zero_dates: a date
    text with zero parts becomes null, and is an error otherwise.
    """
    v = value
    if raw:
        if source.enum:  # an index; a text stays as it is
            index = v.try_cast("int")
            v = F.when(index.isNotNull(), enum_text(index, source.enum)).otherwise(v.cast("string"))
        if source.unsigned_bits:
            v = unsigned(v, source.unsigned_bits)
        if source.charset:
            v = decode_text(v, source.charset)
        if source.binary_length:
            v = pad_binary(v, source.binary_length)
    if isinstance(source.type, T.TimestampNTZType) and isinstance(target.type, T.TimestampType):
        v = datetime_to_instant(v, source.timezone or zone)
    if source.binary_length and target.binary_length > source.binary_length:
        v = pad_binary(v, target.binary_length)
    if isinstance(source.type, T.StringType) and isinstance(target.type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        v = v.try_cast(target.type) if zero_dates else v.cast(target.type)
    else:
        v = v.cast(target.type)
    if target.default is not None and not target.nullable:
        v = F.coalesce(v, F.expr(target.default).cast(target.type))
    return v
