"""SimHash near-duplicates by the generalised pigeonhole principle, and their connected components.

The 64 bits are grouped so that correlated bits share a partition.  If two
fingerprints differ in at most D bits, then in some partition i they differ in
at most t_i bits, whatever thresholds with sum(t_i + 1) = D + 1 are taken.
The number of partitions and the unequal thresholds are chosen by dynamic
programming on the counts of all fingerprints.  Each fingerprint is indexed by
its value in each partition, probes the values within the threshold, and
candidates are verified by the bits in which they differ.

Only distinct fingerprints are linked, so exact copies cost nothing.  A
partition value with more than HOT fingerprints is compared in blocks of BLOCK
x BLOCK, each of which returns a spanning forest and not its pairs.  Components
are joined by alternating large-star and small-star steps with checkpoints.

Defined results: null, empty and wordless texts have fingerprint zero and are
linked like any other; rows with the same id are judged each; a row with a
null id gets a component like any other, which takes its name from the ids
that are not null (null if there is none); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime, simhash

HOT, BLOCK = 512, 4096
BITS = 3
HUB, MAX_HUBS = 1024, 10_000


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, fp: the fingerprint as a signed long) for every row of docs."""

    def run(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(simhash.fingerprints(b.column(1)).view(np.int64))], [id_col, "fp"])

    return docs.select(id_col, F.col("text").cast("string")).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, fp long")


def _correlation(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and the correlations of their bits."""

    def run(it):
        n, both = 0, np.zeros((64, 64))
        for b in it:
            x = np.unpackbits(b.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n += len(x)
            both += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.r_[both.ravel(), n].astype(np.int64))], ["k", "v"])

    rows = nodes.select("fp").mapInArrow(run, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()  # 4097 rows
    v = np.zeros(4097)
    for r in rows:
        v[r["k"]] = r["v"]
    n = int(v[4096])
    both, one = v[:4096].reshape(64, 64) / max(n, 1), np.diag(v[:4096].reshape(64, 64)) / max(n, 1)
    spread = np.sqrt(np.maximum(one * (1 - one), 1e-9))
    return n, (both - np.outer(one, one)) / np.outer(spread, spread)


def plan(nodes: DataFrame, most: int = BITS) -> tuple[list[list[int]], list[int]]:
    """Bit groups and their thresholds."""
    n, corr = _correlation(nodes)
    layouts = [simhash.group_bits(corr, m) for m in (2, 3, 4)]
    flat = [(k, i, bits) for k, groups in enumerate(layouts) for i, bits in enumerate(groups)]

    def run(it):
        for b in it:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, i, bits in flat:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), 8 * k + i)), pa.array(simhash.gather(fp, bits).view(np.int64))], ["part", "value"])

    same = nodes.select("fp").mapInArrow(run, "part long, value long").groupBy("part", "value").count()
    pairs = {r["part"]: r["pairs"] for r in same.groupBy("part").agg(F.sum(F.col("count") * (F.col("count") - 1.0)).alias("pairs")).collect()}
    best = None
    for k, groups in enumerate(layouts):
        costs = [[0.0, *(simhash.probes(len(bits), t) * (n + pairs.get(8 * k + i, 0.0)) for t in range(most + 1))] for i, bits in enumerate(groups)]
        total, t = simhash.allocate(costs, most + 1)
        if best is None or total < best[0]:
            best = (total, groups, t)
    return best[1], best[2]


def links(nodes: DataFrame, most: int = BITS) -> DataFrame:
    """Edges (u, v) that join all fingerprints (column fp, distinct) within ``most`` bits; no pair is lost between components."""
    groups, radius = plan(nodes, most)
    used = [(i, bits, t) for i, (bits, t) in enumerate(zip(groups, radius, strict=True)) if t >= 0]

    def keys(probe: bool):
        def run(it):
            for b in it:
                fp = b.column(0).to_numpy(zero_copy_only=False)
                for i, bits, t in used:
                    for v in simhash.variants(simhash.gather(fp.view(np.uint64), bits), len(bits), t if probe else 0):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), i, np.int32)), pa.array(v.view(np.int64)), pa.array(fp)], ["part", "value", "fp"])

        return nodes.select("fp").mapInArrow(run, "part int, value long, fp long")

    index, probe = runtime.stored(keys(False)), runtime.stored(keys(True))  # read several times
    # hot: a value with many entries, or with many probes for its entries
    counted = index.groupBy("part", "value").agg(F.count("*").alias("n"))
    if any(t > 0 for _, _, t in used):
        counted = counted.join(probe.groupBy("part", "value").agg(F.count("*").alias("p")), ["part", "value"])
    else:
        counted = counted.withColumn("p", F.col("n"))  # every entry is its own only probe
    hot = runtime.cut(counted.where((F.col("n") > HOT) | (F.col("n") * F.col("p") > HOT * HOT)))
    cold = index.join(hot.select("part", "value"), ["part", "value"], "left_anti").withColumnRenamed("fp", "y")
    pairs = probe.withColumnRenamed("fp", "x").join(cold, ["part", "value"]).where("x < y").where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= most)
    found = pairs.select(F.col("x").alias("u"), F.col("y").alias("v"))
    if not hot.isEmpty():
        found = found.union(_hot_links(index, probe, hot, most))
    return found.distinct()


def _hot_links(index: DataFrame, probe: DataFrame, hot: DataFrame, most: int) -> DataFrame:
    """Edges of hot partition values, from blocks of probes against blocks of the index."""
    blocks = hot.select("part", "value", F.ceil(F.col("p") / BLOCK).alias("pb"), F.ceil(F.col("n") / BLOCK).alias("eb"))
    at = lambda n: F.pmod(F.xxhash64("fp"), F.col(n))
    left = probe.join(blocks, ["part", "value"]).select("part", "value", at("pb").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("eb") - 1)).alias("b"), "fp", F.lit(True).alias("probe"))
    right = index.join(blocks, ["part", "value"]).select("part", "value", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pb") - 1)).alias("a"), at("eb").alias("b"), "fp", F.lit(False).alias("probe"))

    def run(t: pa.Table) -> pa.Table:
        fp, p = t["fp"].to_numpy().view(np.uint64), t["probe"].to_numpy()
        u, v = simhash.forest(fp[p], fp[~p], most)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return left.union(right).groupBy("part", "value", "a", "b").applyInArrow(run, "u long, v long")


def star_join(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with facts (one row for each key, n: how many rows have it, and no more columns than a few numbers).

    Hubs, keys of more than HUB rows and of more than one row in MAX_HUBS, are
    at most MAX_HUBS: their facts are sent to all executors, and their rows stay
    where they are.  The other keys' rows are shuffled.
    """
    least = max(HUB, total // MAX_HUBS)
    hubs = F.broadcast(facts.where(F.col("n") > least).drop("n"))  # at most MAX_HUBS rows
    rest = rows.join(hubs.select(key), key, "left_anti").join(facts.where(F.col("n") <= least).drop("n"), key)
    return rows.join(hubs, key).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the least node that it reaches."""
    both = lambda e: e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least_of = lambda e: e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    e = runtime.cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now = state(e)
    while True:
        before = now
        # large star: neighbours above a node go to the least of its neighbourhood
        pairs = both(e)
        low = least_of(pairs).select("u", F.least("u", "m").alias("m"), "n")
        large = runtime.cut(star_join(pairs.where("v > u"), low, "u", 2 * before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: a node and its lower neighbours go to the least of them
        low = least_of(large)
        small = star_join(large, low, "u", before[0])
        e = runtime.cut(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct())
        now = state(e)
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _named(marked: DataFrame, least, most: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows of marked by root, each root's ``least`` (an aggregate over the fingerprints' own), and the number of rows.

    marked: fp and the columns that ``least`` is made of.
    """
    nodes = runtime.cut(marked.groupBy("fp").agg(F.min(least).alias("least"), F.count("*").alias("n")))
    roots = components(links(nodes, most))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = runtime.cut(named)
    total = nodes.agg(F.count("*"), F.sum("n")).first()
    names = named.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n"))
    own = star_join(named.select("root", "fp", F.col("n").alias("rows")), names, "root", total[0]).select("fp", "component", F.col("rows").alias("n"))
    return own, total[1] or 0


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", most: int = BITS) -> DataFrame:
    """(id, fp, component_id) for every row of docs; component_id is the smallest id reachable over links of up to ``most`` bits."""
    runtime.ship(docs.sparkSession)
    marked = runtime.stored(with_fingerprints(docs, id_col))
    own, total = _named(marked, F.col(id_col), most)
    return star_join(marked, own, "fp", total).select(id_col, "fp", F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", most: int = BITS) -> DataFrame:
    """One row of docs for each component: that of the smallest id (a null id after all others), then of the least hash of the whole row.

    Rows are told apart by two hashes of all their columns.  What goes is found
    from ids and hashes; the texts are not shuffled while it is little.
    """
    runtime.ship(docs.sparkSession)
    names = docs.columns
    hashed = docs.withColumns({"_near_a": F.xxhash64(*names), "_near_b": F.xxhash64(F.lit(1), *names)})
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_near_a").alias("a"), F.col("_near_b").alias("b"))
    marked = runtime.stored(with_fingerprints(hashed.select(row.alias("_near_row"), "text"), "_near_row"))
    own, total = _named(marked, F.col("_near_row"), most)
    judged = star_join(marked, own, "fp", total).groupBy("_near_row").agg(F.min("component").alias("component"), F.count("*").alias("n"))
    judged = runtime.stored(judged.select("_near_row", (F.col("_near_row") == F.col("component")).alias("stays"), "n").where("not stays or n > 1"))
    keys = judged.select(F.col("_near_row.a").alias("_near_a"), F.col("_near_row.b").alias("_near_b"), "stays")
    kept = runtime.without(hashed, keys.select("_near_a", "_near_b"), ["_near_a", "_near_b"])
    repeated = runtime.within(hashed, keys.where("stays").select("_near_a", "_near_b"), ["_near_a", "_near_b"]).dropDuplicates(["_near_a", "_near_b"])
    return kept.union(repeated).select(*names)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(runtime.read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
