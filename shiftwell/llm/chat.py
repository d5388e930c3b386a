"""Chat formatting of reply trees, in DataFrame functions only.

Messages are nodes of reply trees.  Iterative self-joins enumerate the paths
from leaves to roots: each round doubles the distance that is known, so that
depth d takes log2(d) rounds.  Branches are ranked by the sum of their scores,
and each chosen path becomes one conversation in a template:

    user       [INST] text [/INST]
    assistant  <s>text</s>
    system     [SYS] text [/SYS]
    others     [ROLE hex of the role] text [/ROLE]

A control string inside a text gets one more backslash behind its bracket, so
that reading back is exact.  The loss mask covers the assistants' texts.

Defined results: a null text is the empty text, a null role the empty role;
messages without a parent, or whose parent is not there, are roots; rows
that repeat (tree, node) are collapsed to the least (role, text, score); ties of
rank go to the smaller leaf; a null tree id is a tree of its own;
messages on a cycle, and those that hang on one, have no root and give no path;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime

_CONTROL = r"(/?(?:s>|INST\]|SYS\]|ROLE[ \]]))"
_BLOCKS = r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|\[SYS\] .*? \[/SYS\]|\[ROLE [0-9A-F]*\] .*? \[/ROLE\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, r"$1$2$3")


def opening(role: Column) -> Column:
    return F.when(role == "user", "[INST] ").when(role == "assistant", "<s>").when(role == "system", "[SYS] ").otherwise(F.concat(F.lit("[ROLE "), F.hex(role), F.lit("] ")))


def closing(role: Column) -> Column:
    return F.when(role == "user", " [/INST]").when(role == "assistant", "</s>").when(role == "system", " [/SYS]").otherwise(" [/ROLE]")


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, back: steps from the leaf) for all root-to-leaf paths of nodes (tree, node, parent).

    A row is done when no node lies ``far`` steps above it; only the others go
    into the next round, so that one long conversation costs the short ones
    nothing.  A node with more steps above it than its tree has nodes stands
    over a cycle: it has no root, and its rows are never done.
    """
    there = nodes.select("tree", F.col("node").alias("parent"))
    size = nodes.groupBy("tree").agg(F.count("*").alias("size"))
    up = nodes.where("parent is not null and parent <> node").join(there, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("up"))
    up = runtime.cut(up.join(size, "tree"))
    leaves = nodes.select("tree", "node").join(up.select("tree", F.col("up").alias("node")), ["tree", "node"], "left_anti")
    walk = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"))
    far, done = 1, None
    while True:
        step = runtime.cut(walk.join(up, ["tree", "node"], "left"))
        own = step.where("up is null").select("tree", "leaf", "node", "back")
        done = own if done is None else done.union(own)
        more = step.where(F.col("size") > far)
        if more.isEmpty():
            return done
        walk = more.select("tree", "leaf", F.explode(F.array(F.struct("node", "back"), F.struct(F.col("up").alias("node"), (F.col("back") + far).alias("back")))).alias("_s")).select("tree", "leaf", "_s.node", "_s.back")
        up = up.where(F.col("size") > far)
        up = runtime.cut(up.join(up.select("tree", F.col("node").alias("up"), F.col("up").alias("top")), ["tree", "up"]).select("tree", "node", F.col("top").alias("up"), "size"))
        far *= 2


def format_trees(messages: DataFrame, best: int | None = None) -> DataFrame:
    """Conversations of messages (tree, node, parent, role, text, score): tree, leaf, rank, formatted, loss (code point spans), score.

    ``best``: how many paths of each tree are kept, all by default.
    """
    m = messages.groupBy("tree", "node").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), "parent")).alias("m"))
    # a tree's name may be null: joins go by a key that is not
    m = runtime.cut(m.select("tree", F.coalesce(F.concat(F.lit("v"), F.col("tree").cast("string")), F.lit("n")).alias("key"), "node", "m.*"))
    walk = paths(m.select(F.col("key").alias("tree"), "node", "parent")).withColumnRenamed("tree", "key")
    block = m.select("tree", "key", "node", "role", "score", opening(F.col("role")).alias("a"), escape(F.col("text")).alias("t"), closing(F.col("role")).alias("z"))
    turns = walk.join(block, ["key", "node"])
    order = Window.partitionBy("key", "leaf").orderBy(F.desc("back"))
    size = F.length("a") + F.length("t") + F.length("z")
    turns = turns.withColumn("end", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    turns = turns.withColumn("begin", F.col("end") - size + F.length("a"))
    whole = turns.groupBy("key", "leaf").agg(
        F.first("tree").alias("tree"), F.sum("score").alias("score"),
        F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), F.concat("a", "t", "z").alias("block"), "role", "begin", (F.col("begin") + F.length("t")).alias("end")))).alias("turns"),
    )
    loss = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["begin"].alias("begin"), t["end"].alias("end")))
    out = whole.select("tree", "key", "leaf", "score", F.array_join(F.transform("turns", lambda t: t["block"]), "").alias("formatted"), loss.alias("loss"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "leaf")))
    return (out if best is None else out.where(F.col("rank") <= best)).drop("key")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""

    def turn(b: Column) -> Column:
        def inner(a: int, z: int) -> Column:
            return unescape(F.substring(b, F.lit(a + 1), F.length(b) - a - z))

        head = F.length(F.regexp_extract(b, r"^\[ROLE [0-9A-F]*\] ", 0))
        other = F.struct(F.unhex(F.regexp_extract(b, r"^\[ROLE ([0-9A-F]*)\]", 1)).cast("string").alias("role"), unescape(F.substring(b, head + 1, F.length(b) - head - 8)).alias("text"))
        known = [("[INST] ", " [/INST]", "user"), ("<s>", "</s>", "assistant"), ("[SYS] ", " [/SYS]", "system")]
        out = other
        for a, z, role in known:
            out = F.when(F.startswith(b, F.lit(a)), F.struct(F.lit(role).alias("role"), inner(len(a), len(z)).alias("text"))).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(formatted, F.lit(_BLOCKS), F.lit(0)), turn)


def masked(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))), "")


def chains(rows: DataFrame) -> DataFrame:
    """Conversations by turn (conv_id, turn, role, text) as trees of one branch; repeated turns follow one another."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return rows.select(F.col("conv_id").alias("tree"), node.alias("node"), "role", "text").withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runtime.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql("SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)")
    out = format_trees(chains(rows.union(more)))
    got = out.select(F.col("tree").alias("conv_id"), "formatted", read_back(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]|SYS\]|ROLE[ \]]))', '\1\\\2\3', 'g'))
             + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 13 ELSE 16 + 2 * octet_length(encode(role)) END AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
