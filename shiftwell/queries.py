"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .control import progress as prog
from .control.throttle import reason_column
from .functions import conversions as conv
from .operators import cdc, checks
from .operators.copy import copy_chunk, insert_ignore, project
from .plans import alter as alters
from .plans import chunks, keys
from .plans.predicates import between, equals, lexicographic, union_ranges
from .sources import control
from .spec import TableSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


# -- key ranges and chunks


@query("SELECT min(o_orderkey) AS min_o_orderkey, max(o_orderkey) AS max_o_orderkey FROM orders")
def key_min_max(spark, d):
    return chunks.key_bounds(table(spark, d, "orders"), ["o_orderkey"])


@query("""SELECT a.conv_id AS min_conv_id, a.turn AS min_turn, b.conv_id AS max_conv_id, b.turn AS max_turn
FROM (SELECT conv_id, turn FROM conversations ORDER BY conv_id, turn LIMIT 1) a, (SELECT conv_id, turn FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 1) b""")
def key_min_max_composite(spark, d):
    return chunks.key_bounds(table(spark, d, "conversations"), ["conv_id", "turn"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 900")
def range_scan_1col(spark, d):
    o = table(spark, d, "orders")
    return o.where(between(["o_orderkey"], [100], [900], schema=o.schema)).select("o_orderkey", "o_totalprice")


@query("SELECT conv_id, turn, role FROM conversations WHERE (conv_id > 3 OR (conv_id = 3 AND turn > 1)) AND (conv_id < 40 OR (conv_id = 40 AND turn <= 2))")
def range_scan_2col(spark, d):
    c = table(spark, d, "conversations")
    return c.where(between(["conv_id", "turn"], [3, 1], [40, 2], schema=c.schema)).select("conv_id", "turn", "role")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_orderkey < 500 OR (l_orderkey = 500 AND l_linenumber < 3) OR (l_orderkey = 500 AND l_linenumber = 3 AND l_partkey <= 100)""")
def range_scan_3col(spark, d):
    li = table(spark, d, "lineitem")
    return li.where(lexicographic(["l_orderkey", "l_linenumber", "l_partkey"], [500, 3, 100], "<=", li.schema)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= (SELECT min(o_orderkey) FROM orders) AND o_orderkey <= 50")
def range_first_chunk_inclusive(spark, d):
    o = table(spark, d, "orders")
    lo = chunks.key_bounds(o, ["o_orderkey"]).first()[0]
    return o.where(between(["o_orderkey"], [lo], [50], True, o.schema)).select("o_orderkey")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 7 AND turn = 1")
def key_equality(spark, d):
    c = table(spark, d, "conversations")
    return c.where(equals(["conv_id", "turn"], [7, 1], c.schema)).select("conv_id", "turn", "role")


@query("""SELECT conv_id, turn FROM conversations WHERE conv_id = 5 AND turn > 0 UNION ALL SELECT conv_id, turn FROM conversations WHERE conv_id > 5 AND conv_id < 60
UNION ALL SELECT conv_id, turn FROM conversations WHERE conv_id = 60 AND turn <= 3""")
def range_union_all_2col(spark, d):
    return union_ranges(table(spark, d, "conversations"), ["conv_id", "turn"], [5, 0], [60, 3]).select("conv_id", "turn")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 10 ORDER BY o_orderkey LIMIT 1 OFFSET 99")
def chunk_end_offset(spark, d):
    return chunks.chunk_end_by_offset(table(spark, d, "orders"), ["o_orderkey"], [10], [1 << 60], 100)


@query("SELECT max(o_orderkey) AS o_orderkey FROM orders HAVING count(*) > 0")
def chunk_end_last(spark, d):
    return chunks.chunk_end_of_rest(table(spark, d, "orders"), ["o_orderkey"], [10], [1 << 60], 10_000_000)


@query("""SELECT chunk_id, count(*) AS n_rows, min(o_orderkey) AS min_o_orderkey, max(o_orderkey) AS max_o_orderkey
FROM (SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 73 AS BIGINT) AS chunk_id FROM orders) GROUP BY chunk_id""")
def chunk_plan(spark, d):
    return chunks.plan_chunks(table(spark, d, "orders"), ["o_orderkey"], 73)


@query("""SELECT chunk_id, count(*) AS n_rows, arg_min(conv_id, k) AS min_conv_id, arg_min(turn, k) AS min_turn, arg_max(conv_id, k) AS max_conv_id, arg_max(turn, k) AS max_turn
FROM (SELECT conv_id, turn, k, CAST((k - 1) // 50 AS BIGINT) AS chunk_id FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS k FROM conversations)) GROUP BY chunk_id""")
def chunk_plan_composite(spark, d):
    return chunks.plan_chunks(table(spark, d, "conversations"), ["conv_id", "turn"], 50)


# -- schema mapping and copy


def _customer(spark, d):
    c = table(spark, d, "customer")
    return c, TableSpec.of("customer", c.schema, ("c_custkey",))


def _migrated(spark, d, change: str) -> DataFrame:
    c, spec = _customer(spark, d)
    a = alters.parse(change)
    t = alters.apply_to(spec, a)
    return project(c, spec, t, keys.shared_columns(spec, t, a))


@query("SELECT c_custkey, c_name AS customer_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def shared_columns_rename(spark, d):
    return _migrated(spark, d, "CHANGE COLUMN c_name customer_name varchar(128)")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def drop_column(spark, d):
    return _migrated(spark, d, "DROP COLUMN c_mktsegment")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, CAST(47 AS INTEGER) AS tier, CAST(NULL AS VARCHAR) AS note FROM customer")
def add_column_default(spark, d):
    return _migrated(spark, d, "ADD COLUMN tier int NOT NULL DEFAULT 47, ADD COLUMN note varchar(10)")


@query("SELECT c_custkey, CAST(47 AS INTEGER) AS c_nationkey, c_name, c_acctbal, c_mktsegment FROM customer")
def drop_and_add_same_name(spark, d):
    return _migrated(spark, d, "DROP COLUMN c_nationkey, ADD COLUMN c_nationkey int NOT NULL DEFAULT 47 AFTER c_custkey")


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, p_size * 2 AS double_size FROM part")
def generated_column(spark, d):
    p = table(spark, d, "part")
    spec = TableSpec.of("part", p.schema, ("p_partkey",))
    a = alters.parse("ADD COLUMN double_size int AS (p_size * 2) VIRTUAL")
    t = alters.apply_to(spec, a)
    return project(p, spec, t, keys.shared_columns(spec, t, a))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 1000 AND o_orderkey % 3 <> 0")
def copy_insert_ignore(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return copy_chunk(o, o.where("o_orderkey % 3 = 0"), ["o_orderkey"], [100], [1000], False, lambda x: x)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0")
def copy_whole_table(spark, d):
    """As copy_insert_ignore, from the least to the greatest key."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    low, high = chunks.key_bounds(o, ["o_orderkey"]).first() or (None, None)
    if low is None:
        return o.limit(0)
    return copy_chunk(o, o.where("o_orderkey % 3 = 0"), ["o_orderkey"], [low], [high], True, lambda x: x)


@query("""SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = lineitem.l_orderkey AND b.l_linenumber = lineitem.l_linenumber AND b.l_quantity > 45) GROUP BY 1, 2""")
def insert_ignore_duplicates(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey")
    return insert_ignore(li.where("l_quantity > 45"), rows, ["l_orderkey", "l_linenumber"])


@query("""SELECT a.l_orderkey, a.l_linenumber, a.l_partkey FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) a
LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber, true AS there FROM lineitem WHERE l_quantity > 45) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE b.there IS NULL""")
def insert_ignore_whole_table(spark, d):
    """As insert_ignore_duplicates, over all of lineitem's keys."""
    li = table(spark, d, "lineitem")
    return insert_ignore(li.where("l_quantity > 45"), li.select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


# -- change data capture: events are a log by user_id in the order of event_id


def _log(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    return e.select(F.col("event_id").alias("seq"), F.lit(0).cast("long").alias("sub_seq"), op.alias("op"), "user_id", "value")


def _base(spark, d) -> DataFrame:
    return table(spark, d, "events").where("user_id % 2 = 0").groupBy("user_id").agg(F.lit(0.5).alias("value"))


_LOG_SQL = "ev AS (SELECT event_id AS seq, user_id, value, CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op FROM events)"
_BASE_SQL = "base AS (SELECT DISTINCT user_id, 0.5::DOUBLE AS value FROM events WHERE user_id % 2 = 0)"


def _one_by_one(base: str, log: str, key: str, value: str) -> str:
    """SQL that applies the events of ``log`` (key, seq, op, value) to ``base`` (key, value) one after the other, as ``st``; the last state of each key is ``fin``."""
    return f"""o AS (SELECT {key}, op, {value}, row_number() OVER (PARTITION BY {key} ORDER BY seq) AS n FROM {log}),
st({key}, n, there, {value}) AS (SELECT k.{key}, CAST(0 AS BIGINT), b.{key} IS NOT NULL, b.{value} FROM (SELECT {key} FROM {base} UNION SELECT {key} FROM {log}) k LEFT JOIN {base} b USING ({key})
  UNION ALL SELECT st.{key}, o.n, CASE o.op WHEN 'I' THEN true WHEN 'D' THEN false ELSE st.there END,
    CASE o.op WHEN 'D' THEN NULL WHEN 'I' THEN CASE WHEN st.there THEN st.{value} ELSE o.{value} END ELSE CASE WHEN st.there THEN o.{value} END END FROM st JOIN o ON o.{key} = st.{key} AND o.n = st.n + 1),
fin AS (SELECT {key}, arg_max(there, n) AS there, arg_max(CASE WHEN there THEN {value} ELSE 0 END, n) AS {value} FROM st GROUP BY 1)"""


@query(f"WITH RECURSIVE {_LOG_SQL}, {_BASE_SQL}, {_one_by_one('base', 'ev', 'user_id', 'value')} SELECT user_id, value FROM fin WHERE there")
def cdc_fold(spark, d):
    return cdc.apply_log(_base(spark, d), _log(spark, d), ["user_id"], ["value"])


@query(f"WITH RECURSIVE {_LOG_SQL}, {_BASE_SQL}, {_one_by_one('base', 'ev', 'user_id', 'value')} SELECT CAST(count(*) FILTER (there) - (SELECT count(*) FROM base) AS BIGINT) AS delta FROM fin")
def cdc_effective_delta(spark, d):
    return cdc.effective_delta(_base(spark, d), _log(spark, d), ["user_id"])


@query("SELECT CAST(coalesce(sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END), 0) AS BIGINT) AS delta FROM events")
def cdc_nominal_delta(spark, d):
    return cdc.nominal_delta(_log(spark, d))


@query("""SELECT event_id AS seq, CAST(0 AS BIGINT) AS sub_seq, CASE WHEN event_id % 5 = 0 THEN 'D' ELSE 'U' END AS op, user_id, value FROM events
UNION ALL SELECT event_id, 1, 'I', user_id + 1000000, value FROM events WHERE event_id % 5 = 0""")
def cdc_split_key_update(spark, d):
    e = table(spark, d, "events")
    after = F.when(F.col("event_id") % 5 == 0, F.col("user_id") + 1_000_000).otherwise(F.col("user_id"))
    ev = e.select(F.col("event_id").alias("seq"), F.lit(0).cast("long").alias("sub_seq"), F.lit("U").alias("op"), F.struct("user_id", "value").alias("before"), F.struct(after.alias("user_id"), "value").alias("after"))
    return cdc.split_key_updates(ev, ["user_id"], ["value"])


@query("""SELECT event_id AS seq, CAST(0 AS BIGINT) AS sub_seq, CASE WHEN event_type = 'signup' THEN 'I' WHEN event_type = 'error' OR event_id % 5 = 0 THEN 'D' ELSE 'U' END AS op, user_id,
CASE WHEN event_type <> 'error' THEN value END AS value FROM events
UNION ALL SELECT event_id, 1, 'I', user_id + 1000000, value FROM events WHERE event_type NOT IN ('signup', 'error') AND event_id % 5 = 0""")
def cdc_split_whole_log(spark, d):
    """As cdc_split_key_update, over inserts, deletes and updates; every fifth event, if an update, changes its key."""
    after = F.when(F.col("event_id") % 5 == 0, F.col("user_id") + 1_000_000).otherwise(F.col("user_id"))
    e = table(spark, d, "events").withColumn("op", F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U"))
    before, new = F.when(F.col("op") != "I", F.struct("user_id", "value")), F.when(F.col("op") != "D", F.struct(F.when(F.col("op") == "U", after).otherwise(F.col("user_id")).alias("user_id"), "value"))
    ev = e.select(F.col("event_id").alias("seq"), F.lit(0).cast("long").alias("sub_seq"), "op", before.alias("before"), new.alias("after"))
    return cdc.split_key_updates(ev, ["user_id"], ["value"])


@query("SELECT event_id, event_type, CASE event_type WHEN 'signup' THEN 'I' WHEN 'click' THEN 'U' WHEN 'error' THEN 'D' ELSE 'NotDML' END AS op FROM events WHERE user_id % 2 = 1")
def cdc_table_filter(spark, d):
    e = table(spark, d, "events").withColumn("db", F.lit("Shop")).withColumn("table", F.when(F.col("user_id") % 2 == 1, "USERS").otherwise("other"))
    kind = F.when(F.col("event_type") == "signup", "WriteRowsEventV2").when(F.col("event_type") == "click", "UpdateRowsEventV2").when(F.col("event_type") == "error", "DeleteRowsEventV2").otherwise("QueryEvent")
    return cdc.table_filter(e, "shop", "users").select("event_id", "event_type", cdc.event_op(kind).alias("op"))


@query("""WITH r AS (SELECT l_orderkey AS seq, CASE l_orderkey % 3 WHEN 0 THEN 'U' WHEN 1 THEN 'I' ELSE 'D' END AS op, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY 1)
SELECT seq, op, CAST(i AS INTEGER) AS sub_seq, CASE op WHEN 'U' THEN ids[2 * i + 1] WHEN 'D' THEN ids[i + 1] ELSE -1 END AS before_id, CASE op WHEN 'U' THEN ids[2 * i + 2] WHEN 'I' THEN ids[i + 1] ELSE -1 END AS after_id
FROM (SELECT *, unnest(range(CASE WHEN op = 'U' THEN len(ids) // 2 ELSE len(ids) END)) AS i FROM r)""")
def cdc_explode_rows(spark, d):
    """An order's lines as one row event."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.struct(x["l_partkey"].alias("id")))
    op = F.when(F.col("seq") % 3 == 0, "U").when(F.col("seq") % 3 == 1, "I").otherwise("D")
    ev = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("seq")).agg(lines.alias("rows")).withColumn("op", op).where("op <> 'U' or size(rows) > 1")
    return cdc.explode_rows(ev).select("seq", "op", "sub_seq", F.coalesce("before.id", F.lit(-1)).alias("before_id"), F.coalesce("after.id", F.lit(-1)).alias("after_id"))


_REPLAY_SQL = f"""WITH RECURSIVE ev AS (SELECT event_id AS seq, user_id + 1 AS c_custkey, value AS balance, CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op FROM events WHERE event_id > 100),
base AS (SELECT c_custkey, c_acctbal AS balance FROM customer), {_one_by_one('base', 'ev', 'c_custkey', 'balance')}
SELECT c_custkey, balance, CAST(47 AS INTEGER) AS tier FROM fin WHERE there"""


@query(_REPLAY_SQL)
def copy_then_replay(spark, d):
    """Flagship: customer copied with a renamed and an added column, then the log after position 100 replayed on it."""
    c, spec = _customer(spark, d)
    a = alters.parse("CHANGE c_acctbal balance double, DROP c_name, DROP c_nationkey, DROP c_mktsegment, ADD tier int NOT NULL DEFAULT 47")
    t = alters.apply_to(spec, a)
    copied = project(c, spec, t, keys.shared_columns(spec, t, a))
    log = _log(spark, d).where("seq > 100").select("seq", "sub_seq", "op", (F.col("user_id") + 1).alias("c_custkey"), F.col("value").alias("balance"), F.lit(47).alias("tier"))
    return cdc.apply_log(copied, log, ["c_custkey"], ["balance", "tier"])


# -- catalog


#: A catalog made of part: a table for each brand, a column for each size, an index for each remainder of the part's number.
_CATALOG_SQL = """c AS (SELECT DISTINCT p_brand AS table_name, 'c' || p_size AS column_name, CASE p_size % 5 WHEN 0 THEN 'tinyint' WHEN 1 THEN 'smallint' WHEN 2 THEN 'int' WHEN 3 THEN 'bigint' ELSE 'varchar' END AS data_type,
  CASE WHEN p_size % 5 = 4 THEN 'utf8mb4' END AS charset, CASE WHEN p_size = 10 THEN 'auto_increment' ELSE '' END AS extra FROM part),
s AS (SELECT DISTINCT p_brand AS table_name, CASE WHEN p_partkey % 7 = 0 THEN 'PRIMARY' ELSE 'k' || (p_partkey % 7) END AS index_name, p_size AS seq, 'c' || p_size AS column_name,
  CASE WHEN p_partkey % 7 <> 0 AND p_size % 6 = 1 THEN 'YES' ELSE '' END AS nullable FROM part)"""
_RANK_SQL = f"""WITH {_CATALOG_SQL},
k AS (SELECT table_name, index_name, count(*) AS n_columns, string_agg(column_name, ',' ORDER BY seq) AS column_names, bool_or(nullable = 'YES') AS has_nullable FROM s GROUP BY 1, 2),
r AS (SELECT k.table_name, index_name, column_names, n_columns, has_nullable, extra = 'auto_increment' AS is_auto_increment, row_number() OVER (PARTITION BY k.table_name ORDER BY index_name <> 'PRIMARY', has_nullable, charset IS NOT NULL,
  CASE data_type WHEN 'tinyint' THEN 0 WHEN 'smallint' THEN 1 WHEN 'int' THEN 2 WHEN 'bigint' THEN 3 ELSE 100 END, n_columns, index_name) AS preference
  FROM k JOIN c ON c.table_name = k.table_name AND c.column_name = split_part(column_names, ',', 1))"""


def _ranked(spark, d) -> DataFrame:
    p = table(spark, d, "part").withColumn("col", F.concat(F.lit("c"), "p_size")).withColumn("r", F.col("p_partkey") % 7)
    kinds = F.when(F.col("p_size") % 5 == 0, "tinyint").when(F.col("p_size") % 5 == 1, "smallint").when(F.col("p_size") % 5 == 2, "int").when(F.col("p_size") % 5 == 3, "bigint").otherwise("varchar")
    columns = p.select(F.col("p_brand").alias("table_name"), F.col("col").alias("column_name"), kinds.alias("data_type"), F.when(F.col("p_size") % 5 == 4, "utf8mb4").alias("charset"), F.when(F.col("p_size") == 10, "auto_increment").otherwise("").alias("extra"))
    stats = p.select(F.col("p_brand").alias("table_name"), F.when(F.col("r") == 0, "PRIMARY").otherwise(F.concat(F.lit("k"), "r")).alias("index_name"), F.col("p_size").alias("seq"), F.col("col").alias("column_name"), F.when((F.col("r") != 0) & (F.col("p_size") % 6 == 1), "YES").otherwise("").alias("nullable"))
    return keys.rank_keys(columns.distinct(), stats.distinct())


@query(_RANK_SQL + " SELECT * FROM r")
def unique_key_rank(spark, d):
    return _ranked(spark, d)


@query("""WITH s AS (SELECT 's' || s_suppkey AS name, ['c' || (s_suppkey % 7), 'c' || (s_suppkey % 11)] AS cols FROM supplier),
t AS (SELECT 't' || n_nationkey AS name, ['c' || (n_nationkey % 7), 'c' || (n_nationkey % 11), 'c' || (n_nationkey % 5)] AS cols, n_nationkey AS ord FROM nation)
SELECT s.name, arg_min(t.name, t.ord) AS target_name FROM s JOIN t ON list_has_all(t.cols, s.cols) GROUP BY 1""")
def shared_unique_keys(spark, d):
    col = lambda c, n: F.concat(F.lit("c"), F.col(c) % n)
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("name"), F.array(*(col("s_suppkey", n) for n in (7, 11))).alias("columns"))
    t = table(spark, d, "nation").select(F.concat(F.lit("t"), "n_nationkey").alias("name"), F.array(*(col("n_nationkey", n) for n in (7, 11, 5))).alias("columns"), F.col("n_nationkey").alias("ord"))
    return keys.shared_keys_frame(s, t)


@query(_RANK_SQL + " SELECT table_name, index_name, column_names FROM r WHERE preference = 1")
def metadata_join(spark, d):
    """The key that each table of a catalog is copied by."""
    return _ranked(spark, d).where("preference = 1").select("table_name", "index_name", "column_names")


# -- checks


@query("SELECT count(*) FILTER (c_nationkey = 7) AS n_child, count(*) FILTER (c_custkey % 25 = 7) AS n_parent FROM customer")
def fk_counts(spark, d):
    refs = table(spark, d, "customer").select(F.concat(F.lit("t"), "c_nationkey").alias("table_name"), F.concat(F.lit("t"), F.col("c_custkey") % 25).alias("referenced_table_name"))
    return checks.foreign_key_counts(refs, "t7")


@query("SELECT count(*) AS n_rows FROM lineitem")
def row_count(spark, d):
    return checks.row_count(table(spark, d, "lineitem"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_new_unique_key(spark, d):
    return checks.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT count(*) FILTER (length(c_name) > 10) AS cut_c_name, count(*) FILTER (length(c_mktsegment) > 8) AS cut_c_mktsegment FROM customer")
def truncation_check(spark, d):
    return checks.truncations(table(spark, d, "customer"), {"c_name": 10, "c_mktsegment": 8})


@query("SELECT count(*) FILTER (CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END IS NULL) AS n_null_keys FROM orders")
def null_key_check(spark, d):
    o = table(spark, d, "orders").withColumn("k", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")))
    return checks.null_keys(o, ["o_orderkey", "k"])


@query("SELECT true AS equal, count(*) AS n_left, count(*) AS n_right FROM orders")
def table_checksum_equal(spark, d):
    o = table(spark, d, "orders")
    t = o.withColumnRenamed("o_totalprice", "price").orderBy(F.desc("o_orderkey"))
    return checks.same_rows(o, t, ["o_orderkey", "o_totalprice"], ["o_orderkey", "price"])


# -- conversions


@query("SELECT event_id, ts + INTERVAL 3 HOUR AS utc FROM events")
def datetime_to_utc(spark, d):
    return table(spark, d, "events").select("event_id", conv.datetime_to_utc(F.col("ts"), "-03:00").alias("utc"))


@query("SELECT p_partkey, CASE p_size % 6 - 1 WHEN 1 THEN 'red' WHEN 2 THEN 'green' WHEN 3 THEN 'blue' END AS color FROM part")
def enum_to_text(spark, d):
    return table(spark, d, "part").select("p_partkey", conv.enum_text(F.col("p_size") % 6 - 1, ("red", "green", "blue")).alias("color"))


@query("""SELECT o_orderkey, v, v + CASE WHEN v < 0 THEN 256 ELSE 0 END AS u8, v + CASE WHEN v < 0 THEN 65536 ELSE 0 END AS u16, v + CASE WHEN v < 0 THEN 16777216 ELSE 0 END AS u24, v + CASE WHEN v < 0 THEN 4294967296 ELSE 0 END AS u32,
CAST(CAST(v AS HUGEINT) + CASE WHEN v < 0 THEN 18446744073709551616::HUGEINT ELSE 0::HUGEINT END AS VARCHAR) AS u64
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN -1 - o_orderkey % 128 ELSE o_orderkey % 128 END AS v FROM orders)""")
def unsigned_decode(spark, d):
    v = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, -1 - F.col("o_orderkey") % 128).otherwise(F.col("o_orderkey") % 128).alias("v"))
    return v.select("o_orderkey", "v", *(conv.unsigned(F.col("v"), b).alias(f"u{b}") for b in (8, 16, 24, 32)), conv.unsigned(F.col("v"), 64).cast("string").alias("u64"))


@query("SELECT c_custkey, lower(hex(encode(c_mktsegment))) || repeat('00', greatest(0, 9 - octet_length(encode(c_mktsegment)))) AS padded FROM customer")
def binary_pad(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.lower(F.hex(conv.pad_binary(F.encode("c_mktsegment", "UTF-8"), 9))).alias("padded"))


@query("SELECT conv_id, turn, text AS txt FROM conversations")
def charset_decode(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", conv.decode_text(F.encode("text", "UTF-8"), "utf8mb4").alias("txt"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 1 THEN date_trunc('second', o_orderdate) END AS ts, o_orderkey % 5 < 2 AS had_zero FROM orders")
def zero_dates(spark, d):
    at = F.when(F.col("o_orderkey") % 5 == 0, "0000-00-00 00:00:00").when(F.col("o_orderkey") % 5 == 1, "1970-00-00 00:00:00").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    ts, zero = conv.zero_date(F.col("t"), strict=False)
    return table(spark, d, "orders").select("o_orderkey", at.alias("t")).select("o_orderkey", ts.alias("ts"), zero.alias("had_zero"))


@query("SELECT p_partkey, unnest(['Threads_running', 'Threads_connected']) AS key, unnest([CAST(p_size AS BIGINT), p_partkey]) AS value FROM part")
def load_map(spark, d):
    text = F.concat(F.lit("Threads_running="), "p_size", F.lit(",Threads_connected="), "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.explode(conv.load_map(text)))


# -- control, checkpoints, progress


def _control_log(spark, d) -> DataFrame:
    """Events as writes to a control table: clicks are heartbeats, signups states, others notes."""
    e = table(spark, d, "events")
    hint = F.when(F.col("event_type") == "click", "heartbeat").when(F.col("event_type") == "signup", "state").otherwise(F.concat("event_type", F.col("user_id") % 10))
    own = F.when(hint == "heartbeat", 1).when(hint == "state", 2).otherwise(256 + F.col("user_id"))
    beat = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    return e.select(F.col("event_id").alias("ord"), own.alias("id"), hint.alias("hint"), F.when(hint == "heartbeat", beat).otherwise(F.col("props")).alias("value"))


_CONTROL_SQL = """l AS (SELECT *, CASE WHEN hint = 'heartbeat' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' ELSE props END AS own, CASE hint WHEN 'heartbeat' THEN 1 WHEN 'state' THEN 2 ELSE 256 + user_id END AS id
FROM (SELECT *, CASE event_type WHEN 'click' THEN 'heartbeat' WHEN 'signup' THEN 'state' ELSE event_type || (user_id % 10) END AS hint FROM events))"""


@query(f"WITH {_CONTROL_SQL} SELECT hint, arg_max(id, event_id) AS id, arg_max(own, event_id) AS value FROM l GROUP BY hint")
def changelog_latest(spark, d):
    return control.latest(_control_log(spark, d))


@query("SELECT 'state' AS hint, CAST(2 AS BIGINT) AS id, arg_max(props, event_id) AS value FROM events WHERE event_type = 'signup'")
def changelog_read_hint(spark, d):
    return control.read_hint(_control_log(spark, d), "state")


@query("SELECT epoch(TIMESTAMP '2026-01-01 00:00:00') - epoch(max(ts)) AS lag_seconds FROM events WHERE event_type = 'click'")
def heartbeat_lag(spark, d):
    return control.heartbeat_lag(_control_log(spark, d), F.lit("2026-01-01T00:00:00Z"))


@query("""SELECT replica, lag AS lag_seconds, error FROM (SELECT 'r' || user_id AS replica, CASE WHEN event_id % 97 = 5 THEN 0 ELSE value END AS lag, CASE WHEN event_id % 97 = 5 THEN 'timeout' || event_id END AS error FROM events)
ORDER BY error IS NOT NULL DESC, lag DESC, replica DESC, error DESC LIMIT 1""")
def control_replica_max_lag(spark, d):
    lost = F.col("event_id") % 97 == 5
    e = table(spark, d, "events").select(F.concat(F.lit("r"), "user_id").alias("replica"), F.when(~lost, F.col("value")).alias("lag_seconds"), F.when(lost, F.concat(F.lit("timeout"), "event_id")).alias("error"))
    return control.replica_lag(e)


@query("SELECT o_orderkey AS id, 'bin.' || o_custkey || ':4' AS coords, o_totalprice AS k_max FROM orders ORDER BY id DESC LIMIT 1")
def checkpoint_last(spark, d):
    return control.checkpoint_last(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("bin."), "o_custkey", F.lit(":4")).alias("coords"), F.col("o_totalprice").alias("k_max")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) // 2 FROM orders)")
def checkpoint_resume_tail(spark, d):
    o = table(spark, d, "orders")
    last = chunks.key_bounds(o, ["o_orderkey"]).first()["max_o_orderkey"] // 2
    return o.where(lexicographic(["o_orderkey"], [last], ">", o.schema)).select("o_orderkey", "o_custkey")


def _scratch(spark) -> str:
    import uuid

    from .runtime import shared_dir

    return f"{shared_dir(spark)}/query-{uuid.uuid4().hex}"


def _raw_log(spark, d) -> DataFrame:
    """Events as raw row events of a table (c_custkey, c_acctbal)."""
    image = F.struct((F.col("user_id") + 1).alias("c_custkey"), F.col("value").alias("c_acctbal"))
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.lit(0).cast("long").alias("sub_seq"), op.alias("op"), image.alias("image"))
    return e.select("seq", "sub_seq", "op", F.when(F.col("op") != "I", F.col("image")).alias("before"), F.when(F.col("op") != "D", F.col("image")).alias("after"))


@query(f"""WITH RECURSIVE ev AS (SELECT event_id AS seq, user_id + 1 AS c_custkey, value AS c_acctbal, CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op FROM events WHERE event_id > 0),
base AS (SELECT c_custkey, c_acctbal FROM customer), {_one_by_one('base', 'ev', 'c_custkey', 'c_acctbal')} SELECT c_custkey, c_acctbal FROM fin WHERE there""")
def revert_replay(spark, d):
    """customer migrated with the first half of the log and swapped in, then reverted: the old version with the whole log."""
    from .migrate import Migration
    from .runtime import cut
    from .sources.store import TableStore
    from .spec import Options

    root, rows, log = _scratch(spark), table(spark, d, "customer").select("c_custkey", "c_acctbal"), _raw_log(spark, d)
    source, target = (TableStore(spark, root, n, single_writer=True) for n in ("customer", "_customer_gho"))
    source.swap(source.write_version(rows), applied_seq=0)
    half = (log.agg(F.max("seq")).first()[0] or 0) // 2
    m = Migration(source, target, TableSpec.of("customer", rows.schema, ("c_custkey",)), "CHANGE c_acctbal balance double, ADD tier int", Options(approve_renames=True))
    m.run(log.where(F.col("seq") <= half))
    m.revert(log)
    out = cut(source.read())
    source._fs.delete(source._path(root), True)
    return out


@query("""SELECT id, percent, CASE WHEN percent >= 100 THEN 0.0 WHEN percent < 0.1 THEN NULL WHEN rate > 0 THEN (w - copied)::DOUBLE / rate ELSE elapsed * (w - copied)::DOUBLE / copied END::DOUBLE AS eta
FROM (SELECT *, CASE WHEN w = 0 THEN 100.0::DOUBLE ELSE 100.0::DOUBLE * copied / w END AS percent FROM (SELECT *, CASE WHEN done THEN copied ELSE est + delta END AS w
FROM (SELECT o_orderkey AS id, o_custkey AS copied, o_custkey * (o_orderkey % 30) // 10 AS est, o_orderkey % 3 AS delta, o_orderkey % 7 = 0 AS done, CAST(o_orderkey % 3 * 10 AS DOUBLE) AS rate, CAST(o_orderkey % 50 + 1 AS DOUBLE) AS elapsed FROM orders)))""")
def progress_eta(spark, d):
    k = F.col("o_orderkey")
    v = table(spark, d, "orders").select(k.alias("id"), F.col("o_custkey").alias("copied"), F.floor(F.col("o_custkey") * (k % 30) / 10).alias("est"), (k % 3).alias("delta"), (k % 7 == 0).alias("done"), (k % 3 * 10).cast("double").alias("rate"), (k % 50 + 1).cast("double").alias("elapsed"))
    pct = prog.progress(F.col("copied"), F.col("est"), F.col("delta"), F.col("done"))
    eta = prog.eta_seconds(pct, F.col("copied"), F.when(F.col("done"), F.col("copied")).otherwise(F.col("est") + F.col("delta")), F.col("rate"), F.col("elapsed"))
    return v.select("id", pct.cast("double").alias("percent"), eta.cast("double").alias("eta"))


@query("""SELECT id, CASE WHEN h THEN 'hibernate' WHEN u THEN 'user' WHEN f THEN 'flag-file' WHEN ld >= 45 THEN 'max-load' WHEN q > 0 THEN 'query' WHEN s <> 200 THEN 'http' WHEN lag > 1500 THEN 'lag' WHEN rl > 1500 THEN 'replica-lag' ELSE 'none' END AS reason
FROM (SELECT o_orderkey AS id, o_orderkey % 50 = 0 AS h, o_orderkey % 23 = 1 AS u, o_orderkey % 19 = 2 AS f, o_custkey % 50 AS ld, CAST(o_custkey % 11 = 0 AS INTEGER) AS q, CASE WHEN o_custkey % 13 = 0 THEN 404 ELSE 200 END AS s, o_custkey % 1700 AS lag, o_orderkey % 1800 AS rl FROM orders)""")
def throttle_reason(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    v = table(spark, d, "orders").select(
        k.alias("id"), (k % 50 == 0).alias("hibernating"), (k % 23 == 1).alias("user_command"), (k % 19 == 2).alias("flag_file"), (c % 50).alias("load"), F.lit(45).alias("max_load"), (c % 11 == 0).cast("int").alias("query_result"),
        F.when(c % 13 == 0, 404).otherwise(200).alias("http_status"), (c % 1700).alias("lag_millis"), (k % 1800).alias("replica_lag_millis"), F.lit(1500).alias("max_lag_millis"),
    )
    return v.select("id", reason_column().alias("reason"))


@query("""SELECT o_orderstatus, c, file_no, pos FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY file_no DESC, pos DESC) AS k
FROM (SELECT o_orderstatus, 999990 + o_orderkey % 20 AS file_no, o_custkey AS pos, 'bin.' || (999990 + o_orderkey % 20) || ':' || o_custkey AS c FROM orders)) WHERE k = 1""")
def binlog_coord_order(spark, d):
    """The latest coordinates of each status, where file numbers gain a digit."""
    f, p = control.file_coordinates(F.col("c"))
    o = table(spark, d, "orders").select("o_orderstatus", F.concat(F.lit("bin."), F.col("o_orderkey") % 20 + 999_990, F.lit(":"), "o_custkey").alias("c")).select("o_orderstatus", "c", f.alias("file_no"), p.alias("pos"))
    return o.groupBy("o_orderstatus").agg(F.max(F.struct("file_no", "pos", "c")).alias("m")).select("o_orderstatus", "m.c", "m.file_no", "m.pos")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id > 3 OR (conv_id = 3 AND turn > 1) ORDER BY conv_id, turn LIMIT 1 OFFSET 39")
def chunk_end_two_columns(spark, d):
    return chunks.chunk_end_by_offset(table(spark, d, "conversations"), ["conv_id", "turn"], [3, 1], [1 << 60, 0], 40)


@query("SELECT conv_id, turn FROM conversations WHERE (conv_id > 3 OR (conv_id = 3 AND turn > 1)) AND conv_id <= 90 ORDER BY conv_id, turn LIMIT 1 OFFSET 39")
def chunk_end_union(spark, d):
    return chunks.chunk_end_of_union(table(spark, d, "conversations"), ["conv_id", "turn"], [3, 1], [90, 1 << 60], 40)


@query("""SELECT chunk_id, count(*) AS n_rows, arg_min(state, k) AS min_state, arg_min(c_custkey, k) AS min_c_custkey, arg_max(state, k) AS max_state, arg_max(c_custkey, k) AS max_c_custkey
FROM (SELECT *, CAST((k - 1) // 100 AS BIGINT) AS chunk_id FROM (SELECT state, c_custkey, row_number() OVER (ORDER BY state, c_custkey) AS k
FROM (SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'done' ELSE 'held' END AS state FROM customer))) GROUP BY chunk_id""")
def chunk_plan_enum(spark, d):
    """An enum in the key is ordered by its text, not by its number."""
    c = table(spark, d, "customer").withColumn("state", conv.enum_text(F.col("c_nationkey") % 3 + 1, ("new", "done", "held")))
    return chunks.plan_chunks(c, ["state", "c_custkey"], 100)


@query("SELECT CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS n_commit, max(event_id) FILTER (event_type = 'purchase') AS safe_seq FROM events")
def stream_safe_position(spark, d):
    from .streaming.apply import safe_position

    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "commit").otherwise("row").alias("kind"))
    n = e.agg(F.count_if(F.col("kind") == "commit").alias("n_commit"), F.lit(1).alias("_k"))
    return n.join(safe_position(e).withColumn("_k", F.lit(1)), "_k").select("n_commit", "safe_seq")


@query(SQL["cdc_fold"])
def cdc_stream_replay(spark, d):
    """The log through Structured Streaming into a stored table: 40 files in shuffled order, transactions of three events that files split."""
    from .runtime import cut
    from .sources.changelog import file_bounds, stream_log
    from .sources.store import TableStore
    from .streaming.apply import finish, replay_stream

    root = _scratch(spark)
    store = TableStore(spark, root, "users", single_writer=True)
    store.swap(store.write_version(_base(spark, d)), applied_seq=None)
    log, files = _log(spark, d).withColumn("sub_seq", F.col("seq") % 3).withColumn("seq", F.floor(F.col("seq") / 3)), f"{root}/log"
    ends = log.agg(F.min("seq").alias("low"), F.max("seq").alias("high")).first()
    size = ((ends.high or 0) - (ends.low or 0)) / 40 + 1
    place = F.pmod(F.floor((F.col("seq") + F.col("sub_seq") - (ends.low or 0)) / size).cast("int") * 17, F.lit(40))
    log.withColumn("_f", place).repartitionByRange(40, "_f").drop("_f").write.parquet(files)
    schema = T.StructType([T.StructField(n, k) for n, k in (("seq", T.LongType()), ("sub_seq", T.LongType()), ("op", T.StringType()), ("user_id", T.LongType()), ("value", T.DoubleType()))])
    bounds = file_bounds(spark, files, schema)
    replay_stream(stream_log(spark, files, schema, 20), store, lambda x: x, ["user_id"], ["value"], f"{root}/checkpoint", files=bounds).awaitTermination()
    finish(store, ["user_id"], ["value"])
    out = cut(store.read())
    store._fs.delete(store._path(root), True)
    return out
