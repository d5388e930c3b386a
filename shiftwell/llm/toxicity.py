"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its byte 3- to 5-grams (with the boundaries), hashed into
BUCKETS rows of an embedding table; its vector is their mean.  A passage of
WINDOW words is the mean of its words, and a linear softmax over that mean
gives its class.  Embeddings and softmax are trained jointly in numpy, on the
passages of whole labelled texts and on the most toxic one of each.  A
word that repeats one of the 23 before it, or has no letter, is left out of the passages.  A
document is as toxic as its most toxic passage, so that a few words in a long
text count.

As the softmax is linear, each subword's share in the log odds is one number:
whole texts are scored by table lookups and running sums over their bytes.

Defined results: a null text, an empty one or one without a word gets the
score of an empty bag (below 0.5); repeated rows are scored each; without
labels of both classes every score is the smoothed share of label 1.  Labelled
texts of more than LONG_BYTES are learnt from last, the shorter ones first, as
far as FIT_BYTES has room for them; a class always keeps one text at least,
its shortest if all are longer.  All texts are scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime
from . import textnp as tn

SIZES = (3, 4, 5)
BUCKETS = 1 << 17
DIM = 4
WINDOW, STEP = 4, 1
LOOK_BACK = 23
FIT_ROWS = 2500  # labelled rows of each class that are learnt from, about
FIT_BYTES = 2_500_000  # and so much text of each class (whole texts)
LONG_BYTES = FIT_BYTES // 10  # longer texts come after all others, so that one costs no other text its place
_SPACE = 0x20
_CLEAN = np.full(256, _SPACE, np.uint8)
_CLEAN[tn.ALNUM] = np.arange(256, dtype=np.uint8)[tn.ALNUM]
_CLEAN[0x41:0x5B] = np.arange(0x61, 0x7B, dtype=np.uint8)


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cleaned bytes with a boundary before, between and after the texts; the texts' new offsets."""
    n = len(offsets) - 1
    out = np.full(len(data) + n + 8, _SPACE, np.uint8)
    shift = np.repeat(np.arange(1, n + 1), np.diff(offsets))
    out[np.arange(len(data)) + shift] = _CLEAN[data]
    return out, offsets + np.arange(1, n + 2)


def subwords(b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size: first bytes and buckets of the n-grams that have a boundary at most at their ends."""
    gap = b == _SPACE
    wide = b.astype(np.uint64)
    out = []
    inner = ~gap[1:-1]
    key = wide[:-1] | (wide[1:] << np.uint64(8))
    for n in SIZES:
        m = len(b) - n + 1
        if m <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        key = key[:m] | (wide[n - 1 :] << np.uint64(8 * (n - 1)))
        ok = inner[:m].copy()
        for k in range(1, n - 2):
            ok &= inner[k : k + m]
        at = np.flatnonzero(ok)
        h = (key[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        out.append((at, (h >> np.uint64(64 - 17)).astype(np.int64)))
    return out


@dataclass
class Model:
    share: np.ndarray  # of each bucket in the log odds
    bias: float
    slope: float  # calibration of a document's highest passage
    offset: float

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The log odds of each text's most toxic passage."""
        docs = len(offsets) - 1
        b, off = padded(data, offsets)
        total, count = np.zeros(len(b) + 1), np.zeros(len(b) + 1)
        for at, bucket in subwords(b):
            # an n-gram belongs to the word of its second byte
            np.add(total[1:], np.bincount(at + 1, weights=self.share[bucket], minlength=len(b)), out=total[1:])
            np.add(count[1:], np.bincount(at + 1, minlength=len(b)), out=count[1:])
        w = tn.Words(b, np.r_[0, off[1:]], tn.ALNUM)
        total, count = np.cumsum(total), np.cumsum(count)
        word = (total[w.end] - total[w.start]) / np.maximum(count[w.end] - count[w.start], 1)
        out = np.full(docs, self.bias)
        if len(word):
            keep, first = fresh(w)
            sums = np.r_[0, np.cumsum(word[keep])]
            passage, doc = passages(first)
            z = self.bias + (sums[passage[:, 1]] - sums[passage[:, 0]]) / (passage[:, 1] - passage[:, 0])
            best = np.full(docs, -np.inf)
            np.maximum.at(best, doc, z)
            out = np.where(np.isfinite(best), best, out)
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        parts = [self.margins(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in tn.chunks(offsets, 1 << 20)]
        z = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -500, 500)))


def lettered(w: tn.Words) -> np.ndarray:
    """Which words have a letter; numbers say nothing."""
    sums = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(w.data >= 0x61, out=sums[1:])
    return sums[w.end] > sums[w.start]


def fresh(w: tn.Words) -> tuple[np.ndarray, np.ndarray]:
    """Words with a letter that differ from the LOOK_BACK words before them in the document, and the documents' first ones among them."""
    h, doc = w.hashes(), w.doc
    h = h + doc.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    old = np.zeros(len(h), bool)
    for k in range(1, min(LOOK_BACK + 1, len(h))):
        old[k:] |= h[k:] == h[:-k]
    keep = np.flatnonzero(~old & lettered(w))
    return keep, np.searchsorted(keep, w.first)


def passages(first: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges of WINDOW words, one every ``step`` words and a last one, and their documents; a shorter text is one."""
    n = np.diff(first)
    many = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // step)), 0)
    doc = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    begin = np.minimum(k * step, np.maximum(n[doc] - WINDOW, 0))
    return np.stack([first[doc] + begin, first[doc] + np.minimum(begin + WINDOW, n[doc])], 1), doc


class Net:
    """Subword embeddings and a linear softmax over their means, fitted jointly by gradient descent.

    A word is the mean of its subwords' embeddings, a bag the mean of its words.
    """

    def __init__(self, grams: np.ndarray, owner: np.ndarray, words: int, seed: int):
        self.used, self.grams = np.unique(grams, return_inverse=True)
        self.owner, self.words = owner, words
        self.size = np.maximum(np.bincount(owner, minlength=words), 1)
        rng = np.random.default_rng(seed)
        self.emb, self.soft, self.bias = rng.standard_normal((len(self.used), DIM)) * 0.1, rng.standard_normal((DIM, 2)) * 0.5, np.zeros(2)

    def vectors(self) -> np.ndarray:
        return np.stack([np.bincount(self.owner, self.emb[self.grams, d], self.words) for d in range(DIM)], 1) / self.size[:, None]

    def descend(self, words: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int) -> None:
        """Minimise the cross entropy of the bags' classes; (words, bag): which word lies in which bag."""
        n = len(y)
        size = np.bincount(bag, minlength=n)[:, None]
        target = np.eye(2)[y]
        state = [[np.zeros_like(a), np.zeros_like(a)] for a in (self.emb, self.soft, self.bias)]
        for step in range(1, epochs + 1):
            v = self.vectors()
            mean = np.stack([np.bincount(bag, v[words, d], n) for d in range(DIM)], 1) / size
            z = mean @ self.soft + self.bias
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - target) * weight[:, None]
            back = g @ self.soft.T / size
            to_word = np.stack([np.bincount(words, back[bag, d], self.words) for d in range(DIM)], 1) / self.size[:, None]
            to_gram = np.stack([np.bincount(self.grams, to_word[self.owner, d], len(self.used)) for d in range(DIM)], 1)
            # subwords of small weight move little: the floor under the root is part of the largest gradient
            for a, grad, (m1, m2), rate, floor in zip((self.emb, self.soft, self.bias), (to_gram, mean.T @ g, g.sum(0)), state, (0.5, 0.1, 0.1), (0.02, 0.1, 0.1), strict=True):
                m1 += 0.1 * (grad - m1)
                m2 += 0.02 * (grad * grad - m2)
                root = np.sqrt(m2 / (1 - 0.98**step))
                a -= rate * (m1 / (1 - 0.9**step)) / (root + floor * max(float(root.max()), 1e-12))

    def model(self) -> Model:
        share = np.zeros(BUCKETS, np.float32)
        share[self.used] = self.emb @ (self.soft[:, 1] - self.soft[:, 0])
        return Model(share, float(self.bias[1] - self.bias[0]), 1.0, 0.0)


def _within(ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of some ranges, and the range that each lies in."""
    size = ranges[:, 1] - ranges[:, 0]
    owner = np.repeat(np.arange(len(ranges)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + ranges[owner, 0], owner


def _balanced(y: np.ndarray) -> np.ndarray:
    """Weights by which both classes weigh one."""
    return 1 / np.maximum(np.bincount(y, minlength=2), 1)[y]


def train(texts: list[str], y: np.ndarray, seed: int = 3, epochs: int = 60, rounds: int = 2) -> Model:
    """Fit on whole texts; every fifth one only calibrates.

    First every passage of a text is a bag of the text's class.  Then, for some
    rounds, each text adds its most toxic passage: the one that its score is
    taken from, so that chance words of clean texts lose weight.
    """
    n = len(texts)
    if not n or y.min() == y.max():
        p = (float(y.sum()) + 1) / (n + 2)
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log(p / (1 - p))))
    data, offsets = tn.buffers(pa.array(texts, pa.large_string()))
    b, off = padded(data, offsets)
    w = tn.Words(b, np.r_[0, off[1:]], tn.ALNUM)
    keep, first = fresh(w)
    _, where, typ = np.unique(w.hashes()[keep], return_index=True, return_inverse=True)
    # subwords of each distinct word
    begin, end = w.start[keep][where], w.end[keep][where]
    pos, _ = _within(np.stack([begin, end], 1))
    vb, vo = padded(b[pos], np.r_[0, np.cumsum(end - begin)])
    found = [(bucket, np.searchsorted(vo, at + 1, "right") - 1) for at, bucket in subwords(vb)]
    net = Net(*(np.concatenate(x) for x in zip(*found, strict=True)), len(where), seed)
    fits = np.arange(n) % 5 != 4

    def bags(step: int) -> tuple[np.ndarray, np.ndarray]:
        ranges, doc = passages(first, step)
        return ranges[fits[doc]], doc[fits[doc]]

    ranges, doc = bags(WINDOW)
    if len(ranges):
        words, bag = _within(ranges)
        net.descend(typ[words], bag, y[doc], _balanced(y[doc]), epochs)
        near, near_doc = bags(STEP)
        for _ in range(rounds):
            score = net.vectors() @ (net.soft[:, 1] - net.soft[:, 0])
            sums = np.r_[0, np.cumsum(score[typ])]
            z = (sums[near[:, 1]] - sums[near[:, 0]]) / (near[:, 1] - near[:, 0])
            order = np.lexsort((-z, near_doc))
            top = order[np.r_[True, near_doc[order][1:] != near_doc[order][:-1]]]
            words, bag = _within(np.concatenate([ranges, near[top]]))
            weight = np.r_[_balanced(y[doc]), _balanced(y[near_doc[top]])] / 2
            net.descend(typ[words], bag, y[np.r_[doc, near_doc[top]]], weight, max(1, epochs // 3))
    model = net.model()
    held = ~fits
    if len(set(y[held])) < 2:
        held = np.ones(n, bool)
    z = np.concatenate([model.margins(data[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a]) for a, e in tn.chunks(offsets, 1 << 20)])
    model.slope, model.offset = _calibrate(z[held], y[held])
    return model


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The cut between the classes with the fewest errors, a slope of the spread.

    The cut lies in the lower third of its gap: what is toxic but not as the
    labelled texts, as misspelt words, has a smaller margin than they.
    """
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    wrong = np.r_[0, np.cumsum(y)] - np.r_[0, np.cumsum(1 - y)]
    k = np.flatnonzero(wrong == wrong.min())
    k = int(k[len(k) // 2])
    lo, hi = z[max(k - 1, 0)], z[min(k, len(z) - 1)]
    slope = 4 / max(float(np.std(z)), 1e-3)
    return slope, -slope * float(lo + (hi - lo) / 3)


def sample(docs: DataFrame, labels: DataFrame, rule: Column, rows: int = FIT_ROWS, size: int = FIT_BYTES) -> tuple[list[str], np.ndarray]:
    """Whole distinct texts and labels of about ``rows`` rows and at most ``size`` bytes of each class, or one text; long ones last.

    Rows are chosen by their hashes and sizes alone; only the chosen texts are gathered.
    """
    y = runtime.labels_of(labels, "toxic", rule)
    some = runtime.sampled(y.where("y = 1"), ["doc_id"], rows).union(runtime.sampled(y.where("y = 0"), ["doc_id"], rows))
    own = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    found = own.select("doc_id", "h", F.octet_length("text").alias("n")).join(F.broadcast(some), "doc_id").distinct()  # about 2 * rows ids
    found = runtime.cut(found)
    picked = runtime.sampled(found.where("y = 1"), ["doc_id", "h"], rows).union(runtime.sampled(found.where("y = 0"), ["doc_id", "h"], rows))  # an id may have many texts
    order = Window.partitionBy("y").orderBy(F.when(F.col("n") > LONG_BYTES, F.col("n")).otherwise(0), F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "h")
    upto, place = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.row_number().over(order)
    chosen = picked.withColumn("upto", upto).withColumn("place", place).where((F.col("upto") <= size) | (F.col("place") == 1)).select("doc_id", "h", "y")
    got = own.join(F.broadcast(chosen), ["doc_id", "h"]).groupBy("doc_id", "h", "y").agg(F.first("text").alias("text")).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "h").select("text", "y").toArrow()
    return got["text"].to_pylist(), np.array(got["y"].to_pylist(), np.int64)


def detect(docs: DataFrame, labels: DataFrame, rule: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, score) for every row of docs; ``rule`` (on doc_id) tells which labels may be learnt from."""
    spark = docs.sparkSession
    runtime.ship(spark)
    bc = spark.sparkContext.broadcast(train(*sample(docs, labels, rule)))  # fixed size

    def run(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bc.value.score(*tn.buffers(b.column(1))))], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col("text").cast("string")).mapInArrow(run, f"{id_col} {kind}, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (runtime.read(spark, sf_dir, t) for t in ("documents", "labels"))
    held = runtime.remainder("doc_id", 5) == 0
    return detect(docs, labels, ~held).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
