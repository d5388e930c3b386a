"""The pipeline's filtering stages judge rows, not ids: null ids and ids that come twice."""

from __future__ import annotations

import corpus_pipeline
from shiftwell.llm import quality

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", "src", len(t)) for k, t in rows], KIND)


def plain(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_quality_judges_rows(spark, docs, sf_dir):
    score = {r.doc_id: r.score for r in quality.op1_quality(spark, sf_dir).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    good, bad = text[max(score, key=score.get)], text[min(score, key=score.get)]
    new = [(10**6, good), (10**6, bad), (None, good), (None, bad)]  # no labels: the fit stays the same
    own = docs.select(*corpus_pipeline.COLUMNS)
    got = corpus_pipeline.quality_stage(spark, own.union(frame(spark, new)), sf_dir)
    assert plain(got.where("doc_id = 1000000 or doc_id is null")) == sorted([(10**6, good), (None, good)], key=str)
    assert plain(got.where("doc_id < 1000000")) == plain(own.where(own.doc_id.isin([k for k, s in score.items() if s >= 0.5])))


def test_near_duplicates_judge_rows(spark, docs, sf_dir, monkeypatch):
    a, b, c = (r.text for r in docs.where("length(text) > 300").orderBy("doc_id").limit(3).collect())
    rows = [(1, a), (5, a), (5, b), (None, a), (None, c), (None, c), (7, b), (7, b), (9, None), (9, None), (8, "")]
    for most in (500_000, 0):
        monkeypatch.setattr(corpus_pipeline.runtime, "SMALL_KEYS", most)
        df = spark.createDataFrame([(k, t, "en", "src", len(t or "")) for k, t in rows], KIND)
        assert plain(corpus_pipeline.near_duplicate_stage(spark, df, sf_dir)) == sorted([(1, a), (5, b), (None, c), (8, "")], key=str)


def test_decontamination_judges_rows(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    clean = "nothing of any benchmark is to be found in here"
    df = frame(spark, [(1, clean), (1, item), (2, item), (None, item), (None, clean)])
    got = corpus_pipeline.decontamination_stage(spark, df, sf_dir)
    assert plain(got) == sorted([(1, clean), (None, clean)], key=str) and got.columns == df.columns
