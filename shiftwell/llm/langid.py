"""Language identification with hyperdimensional profiles.

Every letter class has a random +1/-1 vector of DIM entries.  A trigram binds
(multiplies) its letters' vectors, permuted (rotated) by place; a text bundles
(adds) the vectors of its trigrams; a language's prototype bundles those of
its training texts, each trigram weighted by one over the text's number of them.  A document gets the language
whose prototype has the largest cosine, after the component common to all
prototypes has been taken off both.

Trigrams run over lower-cased letters; every run of other characters is one
boundary.  Letters a-z have classes of their own, all others share the
remaining classes by hash of their code point.

Defined results: ``und`` with score 0 for a null text, or one without a
letter, and where nothing could be learnt; ties go to the first language in
order; repeated rows are judged each; null languages teach nothing; a column
of more than MAX_LANGS different values is no language column, an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

DIM = 1024
MAX_LANGS = 4096  # prototypes that are sent to every worker, 4 KB each
CLASSES = 64
SEED = 11
_CHUNK_CHARS = 1 << 20
_SEP = "\ud800"  # never part of a valid text


def _class_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()], np.int64)
    table[letters] = 27 + (letters * 40503 >> 4) % (CLASSES - 27)
    for k, c in enumerate("abcdefghijklmnopqrstuvwxyz"):
        table[ord(c)] = 1 + k
    # the letters of Latin-1 in order, so that they don't collide
    latin = [c for c in range(0xDF, 0x100) if chr(c).isalpha()]
    table[latin] = 27 + np.arange(len(latin)) % (CLASSES - 27)
    return table


class Space:
    """Letter vectors and the trigram vectors made of them."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        base = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (CLASSES, dim))
        self.by_place = [np.roll(base, k, axis=1) for k in (2, 1, 0)]
        self.table = _class_table()
        self.dim = dim

    def vectors(self, trigrams: np.ndarray) -> np.ndarray:
        a, b, c = self.by_place
        return (a[trigrams // (CLASSES * CLASSES)] * b[trigrams // CLASSES % CLASSES] * c[trigrams % CLASSES]).astype(np.float32)

    def trigrams(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, trigram) of some texts, and which have a letter."""
        joined = _SEP.join(["", *batch, ""]).lower()
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = self.table[points]
        cuts = points == 0xD800
        letter = c > 0
        doc = np.cumsum(cuts, dtype=np.int32) - 1
        keep = np.flatnonzero(np.r_[True, letter[1:] | letter[:-1] | cuts[1:]])
        c, doc, letter = c[keep].astype(np.int32), doc[keep], letter[keep].astype(np.int8)
        ok = np.flatnonzero((letter[:-2] + letter[1:-1] + letter[2:] >= 2) & (doc[1:-1] < len(batch)))
        t = (c[ok] * CLASSES + c[ok + 1]) * CLASSES + c[ok + 2]
        letters = np.bincount(doc[letter > 0], minlength=len(batch))[: len(batch)] > 0
        return doc[ok + 1], t, letters

    def used(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct trigrams in order, and the place of each of t among them."""
        there = np.bincount(t, minlength=CLASSES**3) > 0
        return np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[t]

    def bundles(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Document vectors (unit length) and which texts have a letter."""
        doc, t, letters = self.trigrams(batch)
        out = self.bundle(doc, t, None, len(batch))
        # a text of one or two letters may have no trigram: its vector is zero
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9), letters

    def bundle(self, row: np.ndarray, t: np.ndarray, weights: np.ndarray | None, rows: int) -> np.ndarray:
        """Weighted sums of trigram vectors for each row."""
        used, at = self.used(t)
        out = np.zeros((rows, self.dim), np.float32)
        step = 8192
        for lo in range(0, len(used), step):  # a bounded table of vectors at a time
            width = min(step, len(used) - lo)
            own = slice(None) if len(used) <= step else (at >= lo) & (at < lo + step)
            counts = np.bincount(row[own].astype(np.int64) * width + (at[own] - lo), weights=None if weights is None else weights[own], minlength=rows * width)
            out += counts.reshape(rows, width).astype(np.float32) @ self.vectors(used[lo : lo + width])
        return out


_SPACE: Space | None = None


def space() -> Space:
    global _SPACE
    if _SPACE is None:
        _SPACE = Space()
    return _SPACE


def _groups(batch: list[str]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for i, x in enumerate(batch):
        if i > a and (size + len(x) > _CHUNK_CHARS or i - a >= 400):
            yield a, i
            a, size = i, 0
        size += len(x)
    if a < len(batch):
        yield a, len(batch)


def learn(docs: DataFrame, rule: Column) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from the rows of docs (text, lang) where ``rule`` holds."""
    dim = DIM

    def bundle(it):
        total: dict[str, np.ndarray] = {}
        for b in it:
            text, lang = [x or "" for x in b.column(0).to_pylist()], b.column(1).to_pylist()
            for lo, hi in _groups(text):
                doc, t, _ = space().trigrams(text[lo:hi])
                names, who = np.unique(np.array(lang[lo:hi], object).astype(str), return_inverse=True)
                share = 1 / np.maximum(np.bincount(doc, minlength=hi - lo), 1)  # each text weighs the same
                v = space().bundle(who[doc], t, share[doc], len(names))
                for k, name in enumerate(names):
                    total[str(name)] = total.get(str(name), 0) + v[k].astype(np.float64)
        for name, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dim), pa.array(np.arange(dim)), pa.array(np.round(v * 65536).astype(np.int64))], ["lang", "i", "v"])

    parts = docs.where(rule & F.col("lang").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    # whole numbers: the sum doesn't depend on the order of tasks
    summed = runtime.cut(parts.mapInArrow(bundle, "lang string, i long, v long").groupBy("lang", "i").agg(F.sum("v").alias("v")))
    if (n := summed.count() // dim) > MAX_LANGS:
        raise ValueError(f"{n} languages: more than {MAX_LANGS}")
    rows = summed.toPandas()  # MAX_LANGS x DIM at most
    if not len(rows):
        return [], np.zeros((0, dim))
    p = rows.pivot(index="lang", columns="i", values="v").sort_index()
    v = p.to_numpy(float)
    return list(p.index), v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def identify(docs: DataFrame, rule: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score) for every row of docs."""
    spark = docs.sparkSession
    runtime.ship(spark)
    names, proto = learn(docs, rule)
    common = proto.mean(0) if len(names) > 1 else np.zeros(DIM)
    own = proto - common
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9) if len(names) else 1
    bc = spark.sparkContext.broadcast((names, own.astype(np.float32), common.astype(np.float32)))  # languages x DIM

    def run(it):
        names, own, common = bc.value
        axis = common / max(float(np.linalg.norm(common)), 1e-9)
        for b in it:
            text = [x or "" for x in b.column(1).to_pylist()]
            best, score = np.zeros(len(text), np.int64), np.zeros(len(text))
            for lo, hi in _groups(text):
                v, letters = space().bundles(text[lo:hi])
                v -= np.outer(v @ axis, axis)
                cos = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)) @ own.T if names else np.zeros((hi - lo, 1))
                best[lo:hi] = np.where(letters, cos.argmax(1), -1) if names else -1
                score[lo:hi] = np.where(best[lo:hi] >= 0, (1 + cos.max(1)) / 2, 0)
            lang = [names[k] if k >= 0 else "und" for k in best]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))], [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col("text").cast("string")).mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.read(spark, sf_dir, "documents")
    held = runtime.remainder("doc_id", 4) == 2
    return identify(docs, ~held).select("doc_id", held.alias("held_out"), "lang_pred", "score")
