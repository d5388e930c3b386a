"""URL filters by a cascade of Bloom filters, in DataFrame functions only.

A rule names a host and a path; it fits the host and its subdomains, and every
path that starts with its own.  A URL's candidate keys are its host's suffixes
joined with its path's beginnings (of the lengths that rules have).  For each
verdict, a cascade encodes the listed keys exactly: level 1 holds the listed
keys, level 2 the keys of the corpus that level 1 takes for listed by mistake,
level 3 the listed keys that level 2 takes by mistake, and so on until no
mistake is left.  As the universe is complete (every candidate key of every
URL), the level at which a key first drops out tells its membership, without a
join.  Of the rules that fit the longest wins; none leaves the verdict to the
default, allow, as the cascade then says that nothing is listed.

The filters travel in the plan as arrays of numbers; their size is bounded by
MAX_KEYS listed keys times the bits of a key, which grow with the logarithm of
the corpus.  A longer list is dealt by key hash to parts of about MAX_KEYS,
each with its own cascades and its own pass over the pages.

Defined results: host and path are empty for a null URL or one without
``://``; such URLs get the default; rules that are listed twice count once, if
with either verdict, block wins; ties in length go to the larger rule as text;
repeated pages are judged each; a page's columns that are named like a result
give way to it; empty tables give empty results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

MAX_KEYS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def candidates(h: Column, p: Column, lengths: list[int]) -> Column:
    """All keys under which a rule for (host, path) could be listed."""
    labels = F.split(h, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    starts = F.transform(F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length(p)), lambda n: F.substring(p, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda t: F.concat(s, t))))


@dataclass
class Level:
    """A Bloom filter: number of bits, hashes a key, and the bits in words of 64."""

    bits: int
    hashes: int
    seed: int
    words: list[int]

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(i)), F.lit(self.bits)) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded to one literal
        out = F.lit(True)
        for p in self.places(key):
            word = F.element_at(words, (F.floor(p / 64) + 1).cast("int"))
            out = out & (F.getbit(word, (p % 64).cast("int")) == 1)
        return out


def build_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter of the n keys with about the given rate of false positives; gathered as words, not as keys."""
    hashes = max(1, round(-math.log2(rate)))
    bits = max(64, -(-math.ceil(-n * math.log(rate) / math.log(2) ** 2) // 64) * 64)
    level = Level(bits, hashes, seed, [])
    places = keys.select(F.explode(F.array(*level.places(F.col("key")))).alias("p"))
    rows = places.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v")).collect()  # bits / 64 rows at most
    words = [0] * (bits // 64)
    for r in rows:
        words[r["w"]] = r["v"]
    level.words = words
    return level


@dataclass
class Cascade:
    levels: list[Level]

    def lists(self, key: Column) -> Column:
        """Exact membership of a key of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels), 0, -1):
            out = F.when(self.levels[k - 1].holds(key), out).otherwise(F.lit(k % 2 == 0))
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, seed: int) -> Cascade:
    """listed and universe: distinct keys (column key)."""
    n, u = listed.count(), universe.count()
    if not n:
        return Cascade([])
    others = universe.join(F.broadcast(listed), "key", "left_anti")  # at most MAX_KEYS listed keys
    inside, outside, levels = listed, others, []
    rate = min(0.5, max(2.0**-30, math.sqrt(0.5) * n / max(u, 1)))
    while n:
        level = build_level(inside, n, rate, seed + len(levels))
        levels.append(level)
        # those of the other side that pass are the next level's keys
        wrong = runtime.cut(outside.where(level.holds(F.col("key"))))
        inside, outside, n, rate = wrong, inside, wrong.count(), 0.5
    return Cascade(levels)


def _named(verdict: str):
    return lambda x: F.struct(F.length(x).alias("n"), x.alias("rule"), F.lit(verdict).alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", most: int = MAX_KEYS) -> DataFrame:
    """pages with host, path, rule (text or null) and verdict; rules: host, path, verdict (allow or block)."""
    listed = runtime.cut(rules.where("host is not null and path is not null").select(F.concat("host", "path").alias("key"), F.length("path").alias("n"), "verdict").distinct())
    lengths = sorted(r["n"] for r in listed.select("n").distinct().collect())
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "_host", "_path", "_best")]
    best = pages.select(*kept, host(F.col(url_col)).alias("_host"), path(F.col(url_col)).alias("_path"), F.expr("cast(null as struct<n: int, rule: string, verdict: string>)").alias("_best"))
    keys = candidates(F.col("_host"), F.col("_path"), lengths) if lengths else F.expr("cast(array() as array<string>)")
    parts = max(1, -(-listed.count() // most))

    def in_part(p: int):
        return lambda key: F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts)) == p

    universe = best.select(F.explode(keys).alias("key")).distinct()
    universe = runtime.cut(universe if parts == 1 else universe.repartition("key"))
    for p in range(parts):
        own = keys if parts == 1 else F.filter(keys, in_part(p))
        here = lambda df, p=p: df if parts == 1 else df.where(in_part(p)(F.col("key")))
        found = []
        for k, verdict in enumerate(("allow", "block")):
            cascade = build_cascade(here(listed.where(F.col("verdict") == verdict)).select("key").distinct(), here(universe), 1000 * k)
            if cascade.levels:
                found.append(F.transform(F.filter(own, cascade.lists), _named(verdict)))
        if found:
            best = best.withColumn("_best", F.greatest("_best", F.array_max(F.concat(*found))))
            best = best if p == parts - 1 else runtime.cut(best)  # the filters of one part at a time are in a plan
    return best.select(*kept, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit("allow")).alias("verdict"))


#: (host, path, verdict)
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict)")
    return judge(runtime.read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = rf"""
WITH r(host, path, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
u AS (SELECT page_id, row_number() OVER () AS k, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
             coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
m AS (SELECT k, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
      FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (k)
"""
