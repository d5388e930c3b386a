"""The fitted models against plain versions of their arithmetic, and held-out accuracy."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shiftwell.llm import langid, quality, runtime, stats, toxicity
from shiftwell.llm import textnp as tn

# -- quality


def test_ridge_is_the_normal_equations(spark, big_dir):
    docs, labels = (spark.read.parquet(f"{big_dir}/{t}.parquet") for t in ("documents", "labels"))
    s = runtime.stored(stats.document_stats(docs).select("doc_id", "stats"))
    learn = runtime.remainder("doc_id", 3) != 1
    m = quality.fit(s, labels, "quality", learn)
    rows = s.join(runtime.labels_of(labels, "quality", learn), "doc_id").select("stats", "y", (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(5)) == 0).alias("out"), F.xxhash64(F.col("doc_id").cast("string")).alias("k")).toPandas()
    out = rows.k.mod(5).eq(0).to_numpy()
    x, y = np.stack(rows.stats.to_numpy()).astype(np.float32), rows.y.to_numpy(float)
    assert np.allclose(m.mean, x.mean(0), rtol=1e-3, atol=1e-3)
    z, wt = m.features(x[~out]).astype(float), np.where(y[~out] == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    a = (z * wt[:, None]).T @ z
    beta = np.linalg.solve(a + 1e-3 * np.trace(a) / len(a) * np.eye(len(a)), z.T @ (wt * (2 * y[~out] - 1)))
    assert np.allclose(z @ m.beta, z @ beta, atol=1e-3)
    knots, values = quality.isotonic(m.raw(x[out]), y[out])
    assert np.allclose(np.interp(m.raw(x), knots, values), m.score(x))


def test_isotonic_by_its_definition():
    """The value at i is the largest, over beginnings, of the least mean of the stretches from there across i."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        s, y = np.sort(rng.standard_normal(30)), rng.integers(0, 2, 30).astype(float)
        want = [max(min(y[a : b + 1].mean() for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
        assert np.allclose(np.interp(s, *quality.isotonic(s, y)), want)


def test_scores_without_two_classes(spark, docs):
    for n, y, share in ((10, 1, 11 / 12), (5, 0, 1 / 7), (0, 1, 1 / 2)):
        ids = [r.doc_id for r in docs.orderBy("doc_id").limit(n).collect()]
        labels = spark.createDataFrame([(k, y) for k in ids], "doc_id long, quality int")
        got = {r.score for r in quality.classify(docs.limit(50), labels.where(F.col("doc_id").isin(ids)), F.lit(True)).collect()}
        known = docs.limit(50).where(F.col("doc_id").isin(ids)).count()
        assert np.allclose(list(got), (known * y + 1) / (known + 2)) and (known < n or np.allclose(list(got), share))


def test_many_rows_of_one_label(spark, docs):
    """An id that comes very often doesn't fill the sample: rows are chosen, not ids."""
    text = [r.text for r in docs.where("text is not null").limit(40).collect()]
    many = spark.createDataFrame([(1 if k < 30 else k, f"{t} {j}") for k, t in enumerate(text) for j in range(20)], "doc_id long, text string")
    s = stats.document_stats(many).select("doc_id", "stats")
    y = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id long, y int")
    assert runtime.learnable(s, y, 100).count() < 250


# -- toxicity


def plain_margin(m: toxicity.Model, text: str) -> float:
    words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))]
    score = []
    for k, w in enumerate(words):
        if w in words[max(0, k - toxicity.LOOK_BACK) : k] or not any(c >= 0x61 for c in w):
            continue
        padded, shares = b" " + w + b" ", []
        for n in toxicity.SIZES:
            for i in range(len(padded) - n + 1):
                key = int.from_bytes(padded[i : i + n], "little")
                shares.append(float(m.share[((key + n) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - 17)]))
        score.append(sum(shares) / max(len(shares), 1))
    n = toxicity.WINDOW
    runs = [score[i : i + n] for i in range(max(1, len(score) - n + 1))] if score else []
    return m.bias + max((sum(r) / len(r) for r in runs), default=0.0)


def test_margins_by_plain_python(odd):
    rng = np.random.default_rng(1)
    m = toxicity.Model(rng.standard_normal(toxicity.BUCKETS).astype(np.float32), 0.3, 1.0, 0.0)
    text = [r.text for r in odd.collect() if r.text and len(r.text) < 5000] + ["one two", "12 34 56", "a b c d e f g", "Ab aB x1 éa 7 zz"]
    got = m.margins(*tn.buffers(pa.array(text, pa.large_string())))
    assert np.allclose(got, [plain_margin(m, t) for t in text], atol=1e-4)


def test_toxicity_held_out(spark, big_dir):
    labels = spark.read.parquet(f"{big_dir}/labels.parquet").select("doc_id", "toxic").where("toxic is not null")
    out = toxicity.op2_toxicity(spark, big_dir).join(labels, "doc_id").where("held_out").toPandas()
    assert len(out) > 50 and (out.predicted == out.toxic).mean() > 0.93 and out.score.between(0, 1).all()


def test_unseen_misspellings():
    """Words that share n-grams with toxic ones are toxic, though no text has them."""
    rng = np.random.default_rng(8)
    plain = sorted({"".join(rng.choice(list("aeiortns"), 6)) for _ in range(400)})
    bad = ["grumblor", "snarkwitted", "blorfface", "vexnoggin"]
    y = np.arange(400) % 2
    m = toxicity.train([" ".join([*rng.choice(plain, 15), *(rng.choice(bad, 1) if k else []), *rng.choice(plain, 15)]) for k in y], y)
    sloppy = ["grummblor", "snarkwited", "blorffface", "vexxnoggin"]
    around = lambda w: " ".join([*rng.choice(plain, 10), *w, *rng.choice(plain, 10)])
    z = m.margins(*tn.buffers(pa.array([around([w]) for w in sloppy * 5] + [around([]) for _ in range(60)], pa.large_string())))
    assert (z[:20] > z[20:].max()).mean() >= 0.8
    pairs = pa.array([around(rng.choice(sloppy, 2)) for _ in range(20)] + [around([]) for _ in range(20)], pa.large_string())
    assert (m.score(*tn.buffers(pairs)) >= 0.5).tolist() == [True] * 20 + [False] * 20


def test_one_class_gives_its_share():
    for y, share in (([1, 1, 1], 4 / 5), ([0, 0], 1 / 4), ([], 1 / 2)):
        m = toxicity.train([f"text {k}" for k in range(len(y))], np.array(y, np.int64))
        assert np.allclose(m.score(*tn.buffers(pa.array(["any", "", "thing"]))), share)


# -- language


def plain_vector(space: langid.Space, text: str) -> dict | np.ndarray:
    """The bundle of a text's trigrams, by a dictionary of trigrams."""
    classes, before = [0], True
    for c in text.lower():
        k = int(space.table[ord(c)])
        if k or not before:
            classes.append(k)
        before = not k
    if classes[-1]:
        classes.append(0)
    counts: dict[tuple, int] = {}
    for t in zip(classes, classes[1:], classes[2:], strict=False):
        if sum(x > 0 for x in t) >= 2:
            counts[t] = counts.get(t, 0) + 1
    out = np.zeros(langid.DIM)
    for (a, b, c), n in counts.items():
        out += n * space.by_place[0][a].astype(float) * space.by_place[1][b] * space.by_place[2][c]
    return out, sum(counts.values())


def test_cosines_by_a_dictionary(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 4000").limit(60)
    rule = runtime.remainder("doc_id", 4) != 2
    got = {r.doc_id: r for r in langid.identify(docs, rule).collect()}
    space = langid.space()
    vectors = {r.doc_id: plain_vector(space, r.text or "") for r in docs.collect()}
    proto: dict[str, np.ndarray] = {}
    for r in docs.where(rule).where("lang is not null").collect():
        v, n = vectors[r.doc_id]
        proto[r.lang] = proto.get(r.lang, 0) + v / max(n, 1)
    names = sorted(proto)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    p = np.array([unit(proto[k]) for k in names])
    common = p.mean(0)
    own = [unit(v - common) for v in p]
    for k, (v, _) in vectors.items():
        v = unit(v)
        v = unit(v - (v @ unit(common)) * unit(common))
        cos = [float(v @ o) for o in own]
        if got[k].lang_pred != "und":
            assert abs(got[k].score - (1 + max(cos)) / 2) < 1e-3 and cos[names.index(got[k].lang_pred)] > max(cos) - 1e-3
