"""Corpus pipeline: the stages, their order, and the whole run over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftwell.llm import bpe, decontaminate, neardup, quality, runtime, substring

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more; labels of a third of the ids are never learnt from.

    Each row is judged by its own text, also without an id or with an id that comes twice.
    """
    scored = quality.classify_rows(docs.select(*COLUMNS), runtime.read(spark, sf_dir, "labels"), runtime.remainder("doc_id", 3) != 1)
    return scored.where("score >= 0.5").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: that of the smallest id, of those with that id the one of the least text hash.

    Follows op10's contract: 3-word shingles, at most 3 differing bits, transitive, no check of similarity.
    Rows are judged, not ids: an id may be null (such a row stays only if no row of its group has an id), come twice, or
    come with several texts; of rows that are equal in all columns one stays.
    """
    return neardup.one_of_each(docs.select(*COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one holds; n_chars follows the text."""
    return substring.deduplicate(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with the benchmark; each row is judged by its own text, as in the quality stage."""
    return decontaminate.clean(docs.select(*COLUMNS), runtime.read(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids (packed little-endian 32-bit) of every document, their number, and whether decoding gives the text back."""
    return bpe.encode_checked(docs, bpe.default_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", encoding_stage),
]
#: The classifier's fit, XXH64 and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again, as the next one's docs."""
    docs = runtime.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = runtime.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
