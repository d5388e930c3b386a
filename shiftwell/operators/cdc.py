"""Change data capture: reading events, splitting key changes, folding a log and applying it.

Events are rows of seq, sub_seq, op (I, U, D), key columns and value columns.
Their order is (seq, sub_seq); an insert of a key that is there is ignored, an
update or a delete of a key that isn't does nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_op(kind: Column) -> Column:
    """I, U or D of a row event's type or of a statement's first word; all else, a replace too, is no data change (NotDML)."""
    first = F.trim(F.substring_index(kind, " ", 1))
    is_ = lambda verb, event: (F.lower(first) == verb) | F.startswith(first, F.lit(event))
    return F.when(is_("insert", "WriteRows"), "I").when(is_("update", "UpdateRows"), "U").when(is_("delete", "DeleteRows"), "D").otherwise("NotDML")


def known(op: Column) -> Column:
    """op, or an error where it is none of I, U and D: an event that nobody understands must not be skipped."""
    return F.when(op.isin("I", "U", "D"), op).otherwise(F.raise_error(F.concat(F.lit("unknown event: "), F.coalesce(op, F.lit("null")))))


def table_filter(events: DataFrame, schema: str, table: str) -> DataFrame:
    """Events of one table, names in any case; before any payload is read."""
    return events.where((F.lower("db") == schema.lower()) & (F.lower("table") == table.lower()))


def explode_rows(events: DataFrame) -> DataFrame:
    """Row events (seq, op, rows: array of structs) to one event for each row, numbered by sub_seq.

    An update's rows come in pairs: before, after.
    """
    pairs = F.transform(F.sequence(F.lit(0), (F.size("rows") / 2).cast("int") - 1), lambda i: F.struct(F.get("rows", 2 * i).alias("before"), F.get("rows", 2 * i + 1).alias("after")))
    none = F.expr("get(rows, -1)")
    single = F.transform("rows", lambda r: F.struct(F.when(F.col("op") == "D", r).otherwise(none).alias("before"), F.when(F.col("op") == "I", r).otherwise(none).alias("after")))
    images = F.when(F.size("rows") == 0, F.slice(single, 1, 0)).when(F.col("op") == "U", pairs).otherwise(single)
    keep = [c for c in events.columns if c != "rows"]
    return events.select(*keep, F.posexplode(images).alias("sub_seq", "image")).select(*keep, "sub_seq", "image.before", "image.after")


def split_key_updates(events: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Events with images (before, after: structs) as events by key: an update that changes the key is a delete and an insert.

    sub_seq is doubled, so that the insert comes right after its delete.  An unknown op is an error.
    """
    events = events.withColumn("op", known(F.col("op")))
    same = ~F.lit(False)
    for k in key:
        same = same & F.col(f"before.{k}").eqNullSafe(F.col(f"after.{k}"))

    def image(op: str, side: str, plus: int) -> Column:
        fields = [F.col(f"{side}.{c}").alias(c) if side == "after" or c in key else F.col(f"after.{c}").alias(c) for c in (*key, *values)]
        return F.struct((F.col("sub_seq") * 2 + plus).cast("long").alias("sub_seq"), F.lit(op).alias("op"), *fields)

    parts = F.when(F.col("op") == "I", F.array(image("I", "after", 0))).when(F.col("op") == "D", F.array(image("D", "before", 0))).when(same, F.array(image("U", "after", 0))).otherwise(F.array(image("D", "before", 0), image("I", "after", 1)))
    return events.select("seq", F.explode(parts).alias("_e")).select("seq", "_e.*")


#: Positions of the log that one state covers, about the square root of a long log's length.
SPAN = 100_000


def fold(events: DataFrame, key: Sequence[str], values: Sequence[str], span: int = SPAN) -> DataFrame:
    """What a log does to each key: deleted (a delete came), inserted (an insert after the last delete), ins_*, upd_*.

    Only events after a key's last delete matter.  The state of a key over a
    range of positions (its last delete, then the first insert and the last
    update after it) is a monoid: ranges combine in the order of the log.
    Events are folded into ranges of ``span`` positions by partial aggregates,
    so that of a key's events only one state and the inserts of each range are
    shuffled; then a key's states are combined.  A key with most of the log's
    events has as many states as the log has ranges.
    """
    key, at, row = list(key), F.struct("seq", "sub_seq"), F.struct("seq", "sub_seq", *values)
    ranged = events.groupBy(*key, F.floor(F.col("seq") / span).alias("_r")).agg(
        F.max(F.when(F.col("op") == "D", at)).alias("_d"), F.max(F.when(F.col("op") == "U", row)).alias("_u"), F.collect_list(F.when(F.col("op") == "I", row)).alias("_i"),
    )
    after = lambda x: F.col("_d").isNull() | (F.struct(x["seq"], x["sub_seq"]) > F.col("_d"))
    state = F.struct("_r", F.col("_d").isNotNull().alias("d"), F.array_min(F.filter("_i", after)).alias("i"), F.when(after(F.col("_u")), F.col("_u")).alias("u"))
    states = ranged.select(*key, state.alias("_s")).groupBy(*key).agg(F.collect_list("_s").alias("_s"))
    last = F.array_max(F.transform("_s", lambda s: F.when(s["d"], s["_r"])))
    states = states.withColumn("_last", last).withColumn("_live", F.filter("_s", lambda s: F.col("_last").isNull() | (s["_r"] >= F.col("_last"))))
    out = states.select(*key, "_last", F.array_min(F.transform("_live", lambda s: s["i"])).alias("_i"), F.array_max(F.transform("_live", lambda s: s["u"])).alias("_u"))
    later = F.col("_i").isNull() | (F.struct("_u.seq", "_u.sub_seq") > F.struct("_i.seq", "_i.sub_seq"))
    return out.select(
        *key, F.col("_last").isNotNull().alias("deleted"), F.col("_i").isNotNull().alias("inserted"), (F.col("_u").isNotNull() & later).alias("updated_after"),
        F.col("_u").isNotNull().alias("updated"), *(F.col(f"_i.{v}").alias(f"ins_{v}") for v in values), *(F.col(f"_u.{v}").alias(f"upd_{v}") for v in values),
    )


def apply_log(base: DataFrame, events: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """base (one row for each key) after all events, exactly as if they were applied one by one."""
    return merge(base, fold(events, key, values), key, values)


def merge(base: DataFrame, folded: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    b = base.select(*key, *(F.col(v).alias(f"base_{v}") for v in values), F.lit(True).alias("_there"))
    j = b.join(folded, list(key), "full")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    stays = yes("_there") & ~yes("deleted")
    present = stays | yes("inserted")
    pick = [
        F.when(stays, F.when(yes("updated"), F.col(f"upd_{v}")).otherwise(F.col(f"base_{v}"))).when(yes("updated_after"), F.col(f"upd_{v}")).otherwise(F.col(f"ins_{v}")).alias(v)
        for v in values
    ]
    return j.where(present).select(*key, *pick)


def effective_delta(base: DataFrame, events: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: rows that the log adds to the table, net of inserts and deletes without effect."""
    folded = fold(events.select(*key, "seq", "sub_seq", "op"), key, [])
    b = base.select(*key, F.lit(True).alias("_there"))
    j = folded.join(b, list(key), "left")
    there = F.coalesce("_there", F.lit(False))
    after = (there & ~F.col("deleted")) | F.col("inserted")
    return j.agg(F.coalesce(F.sum(after.cast("long") - there.cast("long")), F.lit(0).cast("long")).alias("delta"))


def nominal_delta(events: DataFrame) -> DataFrame:
    """One row: inserts less deletes, as counted before they are applied."""
    return events.agg(F.coalesce(F.sum(F.when(F.col("op") == "I", 1).when(F.col("op") == "D", -1).otherwise(0)), F.lit(0)).cast("long").alias("delta"))
