"""URL filters and chat formatting: SQL, brute force, odd input."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from shiftwell.llm import chat, urlfilter
from tests.llm.test_text_ops import canonical


@pytest.mark.parametrize(("query", "sql"), [(urlfilter.op6_url_filter, urlfilter.ORACLE_SQL), (chat.op8_chat, chat.ORACLE_SQL)])
def test_same_as_sql(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    out = query(spark, sf_dir)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert canonical(out.toPandas()) == canonical(con.sql(sql).df())


def plain_verdict(url, rules):
    rest = (url or "").split("://", 1)
    if len(rest) < 2:
        return "", "", None, "allow"
    import re

    host, path = re.match(r"([^/?#]*)([^?#]*)", rest[1], re.S).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, "allow")))


@pytest.mark.parametrize("joined", [False, True])
def test_filters_by_brute_force(spark, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(urlfilter, "MAX_KEYS", 5)
    rng = random.Random(1)
    hosts, paths = ["com", "a.com", "b.a.com", "net", "x.net", "org"], ["/", "/en/", "/en/7", "/de/", "/é"]
    rules = [(h, p, rng.choice(["allow", "block"])) for h in hosts for p in paths if rng.random() < 0.5] + [("com", "/zz", "block")]
    urls = [f"http{s}://{rng.choice(['', 'W.', 'q.r.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '7', 'x?y=/en/', '#z'])}" for s in ("", "s") for _ in range(150)]
    urls += [None, "", "no scheme", "://", "http://", "http://com", "HTTP://A.COM/en/", "http://com./en/", "x://y://com/en/", "http://" + "a." * 60 + "com/en/\n"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = urlfilter.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(out) == len(urls)
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(urls[r.page_id], rules)


def test_cascade_is_exact_and_empty_lists(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("rand(3) < 0.02").cache()
    c = urlfilter.build_cascade(listed, universe, 5)
    got = {r.key for r in universe.where(c.lists(F.col("key"))).collect()}
    assert got == {r.key for r in listed.collect()} and len(c.levels) > 1
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert urlfilter.judge(pages, none).first().verdict == "allow" and urlfilter.judge(pages.limit(0), none).count() == 0


def test_trees(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9), ("t", 4, 3, "user", None, 0.0), ("t", 5, 4, "tool]", "[/ROLE] <s>", 0.5)]
    rows += [("t", 2, 1, "assistant", "bad", 0.1), (None, 1, None, None, "alone", None), ("d", 7, 99, "system", "root without parent", 1.0), ("c", 1, 2, "user", "cycle", 0.0), ("c", 2, 1, "user", "cycle", 0.0)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "tree string, node long, parent long, role string, text string, score double, m int")
    out = {(r.tree, r["rank"]): r for r in chat.format_trees(df).select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss")).alias("under")).collect()}
    assert set(out) == {("t", 1), ("t", 2), (None, 1), ("d", 1)}
    best = out["t", 1]
    assert [(t.role, t.text) for t in best.turns] == [("user", "q"), ("assistant", "good"), ("user", ""), ("tool]", "[/ROLE] <s>")] and best.under == "good"
    assert [(t.role, t.text) for t in out[None, 1].turns] == [("", "alone")]
    assert chat.format_trees(df, best=1).count() == 3 and chat.format_trees(df.limit(0)).count() == 0


def test_deep_chain(spark):
    df = spark.range(1, 301).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    r = chat.format_trees(chat.chains(df)).select(chat.read_back(F.col("formatted")).alias("t")).collect()
    assert len(r) == 1 and [x.text for x in r[0].t] == [str(i) for i in range(1, 301)]


def test_escapes_are_reversible(spark):
    rng = random.Random(6)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[ROLE ", "[/ROLE]", "\\", "<", "[", "]", "/", "s>", " ", "\n", "INST", "é", "<\\s>", "[\\\\/INST]", "$1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(1500)]
    rows = [(i, 1, None, rng.choice(["user", "assistant", "system", "x y"]), t, 0.0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    for r in chat.format_trees(df).select("tree", chat.read_back(F.col("formatted")).alias("t"), chat.masked(F.col("formatted"), F.col("loss")).alias("m")).collect():
        assert [(x.role, x.text) for x in r.t] == [(rows[r.tree][3], texts[r.tree])]
        assert r.m == (texts[r.tree] if rows[r.tree][3] == "assistant" else "")


def test_repeated_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "user", "n")], "conv_id long, turn long, role string, text string")
    out = {r.tree: [x.text for x in r.t] for r in chat.format_trees(chat.chains(df)).select("tree", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert out == {1: ["", "a", "a"], None: ["n"]}


def test_leaf_on_a_cycle(spark):
    """What hangs on a cycle has no root: no conversation is made up; other trees of any depth stay whole."""
    rows = [("c", 1, 2, "user", "A", 0.0), ("c", 2, 1, "user", "B", 0.0), ("c", 3, 1, "user", "leaf", 0.0), ("c", 4, 3, "user", "leaf of it", 0.0), ("c", 9, None, "user", "own root", 0.0)]
    rows += [("d", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(37)] + [("e", 1, None, None, "x", 0.0)]
    out = chat.format_trees(spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")).select("tree", chat.read_back(F.col("formatted")).alias("t")).collect()
    assert sorted((r.tree, [t.text for t in r.t]) for r in out) == [("c", ["own root"]), ("d", [str(i) for i in range(37)]), ("e", ["x"])]


@pytest.mark.parametrize("most", [100_000, 300])
def test_many_rules(spark, most):
    """Lists as long as one cascade takes, and lists in parts, against a dictionary."""
    n = 100_000 if most == 100_000 else 500
    rules = spark.range(n).selectExpr("concat('h', id, '.org') as host", "if(id % 3 = 0, '/a', '/') as path", "if(id % 5 = 0, 'allow', 'block') as verdict")
    rules = rules.union(spark.sql("select 'org', '/', 'block'")).union(spark.sql("select 'h6.org', '/a', 'block'"))
    pages = spark.range(0, 4000).selectExpr("id as page_id", "concat('http://x.h', id * 50, '.org/', if(id % 2 = 0, 'a/b', 'b')) as url", "1 as rule")
    out = urlfilter.judge(pages, rules, most=most).collect()
    assert len(out) == 4000
    for r in out:
        i = r.page_id * 50
        rule = None
        if i < n and (i % 3 or r.page_id % 2 == 0):
            rule = f"h{i}.org/" + ("a" if i % 3 == 0 else "")
        verdict = "block" if rule is None or i % 5 or i == 6 else "allow"
        assert (r.rule, r.verdict) == (rule or "org/", verdict)
