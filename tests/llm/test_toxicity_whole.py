"""Toxicity: long texts in the training sample, passages at any place."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftwell.llm import stats, toxicity


@pytest.mark.parametrize("size", [toxicity.FIT_BYTES * 6 // 5, toxicity.FIT_BYTES - 500])
def test_long_text_costs_only_itself(spark, size):
    """The first text of either class in hash order is longer than FIT_BYTES, or nearly fills it."""
    ids = [r[0] for r in spark.range(60).orderBy(F.xxhash64(F.col("id").cast("string"))).collect()]
    first = {next(i for i in ids if i % 2 == c) for c in (0, 1)}
    rng = np.random.default_rng(5)
    plain = ["".join(rng.choice(list("aeiortns"), 5)) for _ in range(200)]
    text = {i: " ".join([*rng.choice(plain, 30), *(["grumblor snarkwit blorfface"] if i % 2 else []), *rng.choice(plain, 30)]) for i in ids}
    docs = spark.createDataFrame([(i, (t + " ") * (size // (len(t) + 1)) if i in first else t) for i, t in text.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    texts, y = toxicity.sample(docs, labels, F.lit(True))
    assert set(text.values()) - {text[i] for i in first} <= set(texts) and len(set(y)) == 2
    assert all(sum(len(t) for t, c in zip(texts, y, strict=True) if c == k) <= toxicity.FIT_BYTES for k in (0, 1))
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.detect(docs, labels, F.lit(True)).collect()}
    assert got == {i: i % 2 == 1 for i in ids}


def test_passages_start_at_every_word():
    rng = np.random.default_rng(2)
    plain = sorted({"".join(rng.choice(list("aeiortns"), 5)) for _ in range(300)})
    bad = ["grumblor", "snarkwit", "blorfface", "vexnoggin"]
    y = np.arange(200) % 2
    m = toxicity.train([" ".join([*rng.choice(plain, 20), *(bad if k else []), *rng.choice(plain, 20)]) for k in y], y, epochs=40)
    runs = [" ".join([*plain[:k], *bad, *plain[k:30]]) for k in range(8)]
    z = m.margins(*stats.tn.buffers(stats.pa.array([*runs, " ".join(bad)])))
    assert np.allclose(z, z[-1])
