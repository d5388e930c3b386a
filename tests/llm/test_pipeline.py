"""The pipeline's stages against plain versions of them."""

from __future__ import annotations

import re

import numpy as np
import pytest

import corpus_pipeline
from shiftwell.llm import bpe, quality, runtime
from tests.llm.test_text_ops import plain_components, plain_dedup, plain_hits, plain_print


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Rows of documents, then those after each stage."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [df]
    for _, stage in corpus_pipeline.STAGES:
        df = runtime.stored(stage(spark, df, sf_dir))
        out.append(df)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, sf_dir, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "BPE encoding and decoding"]
    docs, good, single, trimmed, clean, ids = map(rows, stages)
    assert all(s.columns == stages[0].columns for s in stages[1:5])

    score = {r.doc_id: r.score for r in quality.op1_quality(spark, sf_dir).collect()}
    assert set(good) == {k for k in docs if score[k] >= 0.5} and 0 < len(good) < len(docs)
    comp = plain_components({k: plain_print(r.text) for k, r in good.items()})
    assert set(single) == set(comp.values())
    kept = plain_dedup({k: r.text for k, r in single.items()})
    assert set(trimmed) == set(single)
    for k, r in trimmed.items():
        assert re.findall(r"[^\x20\x09-\x0D]+", r.text) == kept[k] and r.n_chars == len(r.text) and (r.lang, r.source) == (docs[k].lang, docs[k].source)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {k for k, r in trimmed.items() for n, h, _, _ in [plain_hits(r.text, items)] if h and 20 * h >= n}
    assert set(clean) == set(trimmed) - bad
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.default_path())
    assert set(ids) == set(clean)
    for k, r in ids.items():
        assert r.exact and np.frombuffer(bytes(r.ids), "<u4").tolist() == tokenizer.encode(clean[k].text, add_special_tokens=False).ids


def test_odd_documents(spark, odd, sf_dir):
    docs = odd.withColumnRenamed("doc", "n_chars").select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = runtime.stored(stage(spark, docs, sf_dir))
    assert docs.where("not exact").count() == 0
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = runtime.stored(stage(spark, empty, sf_dir))
    assert empty.count() == 0
