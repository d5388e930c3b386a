"""Document statistics, shared by the quality classifier and the quality rules.

``document_stats(df)`` adds to every row the counts that the rules fix and
scale-free statistics of its whole text.  A null text counts as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime
from . import textnp as tn

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_BINS = np.zeros(256, np.int64)  # byte classes
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&<>", b"|", b"!?", b".,;:'\"()-", b" ", b"\n", b"\t\v\f\r", b"/@_=+~^`\\[]{}"), 1):
    _BINS[list(_chars)] = _k
_BINS[128:192], _BINS[192:] = 12, 13  # continuation and leading bytes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "log_chars", "word_len", "upper", "digits", "symbols", "pipes", "shouts", "stops", "others", "beyond_ascii",
    "distinct_words", "same_next", "repeat_words", "dup_lines", "line_words", "lone_marks", "long_words", "top_word", "trigram_distinct",
)
SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("stats", T.ArrayType(T.FloatType()))])


def _chunk(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and statistics of some documents."""
    docs = len(offsets) - 1
    w = tn.Words(data, offsets)
    h, doc, n = w.hashes(), w.doc, w.count
    inside = np.zeros((docs, 14), np.int64)
    owner = np.repeat(np.arange(docs), np.diff(offsets))
    if len(data):
        inside = np.bincount(owner * 14 + _BINS[data], minlength=docs * 14).reshape(docs, 14)
    size = np.diff(offsets)
    points = size - inside[:, 12]
    symbols = inside[:, 4] + inside[:, 5]

    # lines with a word, equal to an earlier one of the document
    ends = np.flatnonzero(data == 10)
    begin, end = np.sort(np.r_[offsets[:-1], ends + 1]), np.sort(np.r_[ends, offsets[1:]])
    if len(begin):
        line_doc = np.searchsorted(offsets, begin, "right") - 1
        # an empty text, or a text that ends in a line feed, has empty last lines: without a word they don't count
        at = np.r_[0, np.cumsum(np.ones(len(w.start), np.int64))]
        words_in = at[np.searchsorted(w.start, end)] - at[np.searchsorted(w.start, begin)]
        has = (words_in > 0) & (end > begin)
        begin, end, line_doc = begin[has], end[has], np.minimum(line_doc[has], docs - 1)
        _, later = tn.repeats(line_doc, w.spans_hash(begin, end))
        dup = np.bincount(line_doc[later], minlength=docs)
        lines = np.bincount(line_doc, minlength=docs)
    else:
        dup = lines = np.zeros(docs, np.int64)

    # words in windows of 8 that the text has twice or more
    g, at = w.grams(8)
    many, _ = tn.repeats(doc[at], g)
    repeat = tn.per_doc(tn.covered(len(h), at[many], 8), w.first)
    g3, at3 = w.grams(3)
    _, later3 = tn.repeats(doc[at3], g3)
    n3 = np.bincount(doc[at3], minlength=docs)
    dup3 = np.bincount(doc[at3][later3], minlength=docs)
    _, later = tn.repeats(doc, h)
    distinct = n - np.bincount(doc[later], minlength=docs)
    same = np.zeros(docs)
    top = np.zeros(docs)
    if len(h) > 1:
        same = np.bincount(doc[1:], weights=(h[1:] == h[:-1]) & (doc[1:] == doc[:-1]), minlength=docs)
    length = w.end - w.start
    lone = np.bincount(doc, weights=(length == 1) & (_BINS[data[w.start]] >= 3) if len(h) else None, minlength=docs)
    far = np.bincount(doc, weights=length > 24 if len(h) else None, minlength=docs)
    if len(h):
        key = np.sort(tn.mix(h + doc.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(24) | (doc.astype(np.uint64) << np.uint64(40)))
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        np.maximum.at(top, (key[edges[:-1]] >> np.uint64(40)).astype(np.int64), np.diff(edges))
    white = inside[:, 8] + inside[:, 9] + inside[:, 10]
    word_chars = points - white
    counts = np.stack([n, word_chars, symbols, dup, repeat], 1)
    some, letters, chars = np.maximum(n, 1), np.maximum(inside[:, 1] + inside[:, 2], 1), np.maximum(word_chars, 1)
    stats = np.stack([
        np.log1p(n), np.log1p(points), word_chars / some, inside[:, 1] / letters, inside[:, 3] / chars, inside[:, 4] / chars, inside[:, 5] / some, inside[:, 6] / some,
        inside[:, 7] / some, inside[:, 11] / some, inside[:, 13] / chars, distinct / some, same / some, repeat / some, dup / np.maximum(lines, 1),
        n / np.maximum(lines, 1) / (20 + n / np.maximum(lines, 1)), lone / some, far / some, top / some, 1 - dup3 / np.maximum(n3, 1),
    ], 1).astype(np.float32)
    return counts, stats


def text_stats(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = tn.buffers(col)
    parts = [_chunk(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in tn.chunks(offsets)]
    if not parts:
        return np.zeros((0, len(COUNTS)), np.int64), np.zeros((0, len(FEATURES)), np.float32)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _batches(it):
    for b in it:
        counts, stats = text_stats(b.column(1))
        cols = [pa.array(counts[:, k]) for k in range(len(COUNTS))]
        cols.append(pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, len(FEATURES), dtype=np.int32)), pa.array(stats.ravel())))
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *COUNTS, "stats"])


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, counts, stats) for each row of docs, in one pass over the texts."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_batches, T.StructType([own.schema["doc_id"], *SCHEMA.fields]))


def matrix(col: pa.ChunkedArray) -> np.ndarray:
    """Rows of statistics as a matrix."""
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in col.chunks]
    return np.concatenate([*parts, np.zeros(0, np.float32)]).reshape(-1, len(FEATURES)).astype(np.float32)


def labelled_sample(stats: DataFrame, labels: DataFrame, target: str, rule, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of about ``limit`` labelled rows, chosen by the hash of their ids.

    ``rule`` is a Column over doc_id that holds for the rows that may be learnt from.
    """
    got = runtime.learnable(stats.select("doc_id", "stats"), runtime.labels_of(labels, target, rule), limit).toArrow().sort_by("doc_id")
    if not got.num_rows:
        return np.zeros((0, len(FEATURES)), np.float32), np.zeros(0, np.int64)
    return matrix(got["stats"]), got["y"].to_numpy().astype(np.int64)
