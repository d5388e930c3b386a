"""Quality, toxicity, rules, language: held-out accuracy, exact counts, odd input."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftwell.llm import langid, quality, rules, runtime, stats, toxicity


def test_isotonic():
    k, v = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert np.allclose(np.interp([1, 2, 3, 4], k, v), [0, 0.5, 0.5, 1])


def test_quality_held_out(spark, big_dir):
    labels = spark.read.parquet(f"{big_dir}/labels.parquet").select("doc_id", "quality")
    out = quality.op1_quality(spark, big_dir).join(labels, "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.95 and out.score.between(0, 1).all()


def test_rules_held_out_and_counts(spark, big_dir):
    labels = spark.read.parquet(f"{big_dir}/labels.parquet").select("doc_id", "quality")
    docs = spark.read.parquet(f"{big_dir}/documents.parquet").select("doc_id", "text")
    out = rules.op4_quality_rules(spark, big_dir)
    held = out.join(labels, "doc_id").where(runtime.remainder("doc_id", 3) == 1).where("not base_failed").toPandas()
    assert (held.kept == (held.quality == 1)).mean() > 0.95
    for r in out.join(docs, "doc_id").where("doc_id % 7 = 0").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(r.text)


def plain_counts(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    win = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    from collections import Counter

    c = Counter(win)
    hit = {j for i, w in enumerate(win) if c[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_counts_of_odd_texts(odd):
    for r in stats.document_stats(odd).join(odd.select("doc_id", "text"), "doc_id").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(r.text)


def test_trees_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3)).astype(np.float32)
    y = ((x[:, 0] + 0.3 * rng.random(800)) < 0.6).astype(int)
    t = rules.boost(x, y, np.array([-1, 0, 0]))
    grid = np.repeat(x[:50], 20, 0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 20), 50)
    m = t.margin(grid).reshape(50, 20)
    assert (np.diff(m, axis=1) <= 1e-9).all() and ((t.margin(x) > 0) == y).mean() > 0.9


def test_toxicity_of_unseen_spellings():
    rng = np.random.default_rng(1)
    plain = ["".join(rng.choice(list("aeiortns"), 5)) for _ in range(400)]
    bad = ["grumblor", "snarkwit", "blorfface"]
    text, y = [], []
    for i in range(300):
        w = list(rng.choice(plain, 60))
        if i % 3 == 0:
            for _ in range(4):
                w[rng.integers(60)] = bad[rng.integers(3)] + ["", "s", "en"][rng.integers(3)]
        text.append(" ".join(w))
        y.append(int(i % 3 == 0))
    m = toxicity.train(text, np.array(y), epochs=40)
    score = lambda t: m.score(*stats.tn.buffers(stats.pa.array(t)))
    s = score(text)
    assert ((s >= 0.5) == np.array(y)).mean() > 0.95
    clean = " ".join(plain[:50])
    assert score([clean + " grumblorz " + clean])[0] > score([clean + " " + clean])[0]


def test_toxicity_runs_whole_table(spark, sf_dir):
    out = toxicity.op2_toxicity(spark, sf_dir).toPandas()
    assert len(out) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and out.score.between(0, 1).all()


def test_language_held_out(spark, big_dir):
    out = langid.op9_langid(spark, big_dir).join(spark.read.parquet(f"{big_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.97


def test_odd_input(spark, odd, odd_labels):
    n = odd.count()
    learn = runtime.remainder("doc_id", 3) != 1
    for out in (quality.classify(odd, odd_labels, learn), toxicity.detect(odd, odd_labels, learn), langid.identify(odd, learn)):
        pdf = out.toPandas()
        assert len(pdf) == n and pdf.score.between(0, 1).all()
    lang = {r.doc_id: r.lang_pred for r in langid.identify(odd, learn).collect()}
    assert lang[25] == lang[26] == lang[27] == "und"
    kept = rules.judge(odd, odd_labels, learn).toPandas()
    assert len(kept) == n and not kept[kept.base_failed].kept.any()


@pytest.mark.parametrize("f", [lambda d, lab: quality.classify(d, lab, F.lit(True)), lambda d, lab: toxicity.detect(d, lab, F.lit(True)), lambda d, lab: rules.judge(d, lab, F.lit(True)), lambda d, lab: langid.identify(d, F.lit(True))])
def test_empty_tables_and_no_labels(odd, odd_labels, f):
    assert f(odd.limit(0), odd_labels).count() == 0
    out = f(odd, odd_labels.limit(0)).toPandas()
    assert len(out) == odd.count()
