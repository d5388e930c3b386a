"""Quality rules: fixed base limits and gradient-boosted trees over document statistics.

The trees are grown on histograms in numpy, with monotonic constraints on
chosen statistics (more symbols or more repetition never raise the score), and
flattened into node arrays that score a batch level by level.

Defined results: null and empty texts have no words and fail the base limits;
repeated rows and ids are judged each; without both classes of labels the
trees are empty and the base limits alone decide; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .stats import COUNTS, FEATURES, document_stats, labelled_sample

FIT_ROWS = 40_000  # labelled rows that are learnt from, about
#: Direction in which the score may move as the statistic grows.
MONOTONE = {"symbols": -1, "pipes": -1, "shouts": -1, "repeat_words": -1, "dup_lines": -1, "same_next": -1, "lone_marks": -1, "distinct_words": 1}


@dataclass
class Trees:
    """Flattened trees: node arrays, the root of each tree, the depth, and the base score (log odds)."""

    feature: np.ndarray  # -1: leaf
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            go = x[rows, np.maximum(f, 0)] <= self.cut[at]
            at = np.where(f < 0, at, np.where(go, self.left[at], self.right[at]))
        return self.base + self.value[at].sum(1)


def boost(x: np.ndarray, y: np.ndarray, signs: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, lam: float = 1.0, least: int = 10) -> Trees:
    """Newton boosting of log loss with histogram splits; signs: +1, -1 or 0 for each feature."""
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    n = len(y)
    if not n or y.min() == y.max():
        return Trees(*(np.zeros(0, k) for k in (np.int64, np.float32, np.int64, np.int64, float)), np.zeros(0, np.int64), 0, 0.0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for j in range(x.shape[1])]
    b = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    f = np.full(n, base)
    offset = np.arange(x.shape[1]) * bins

    def node(v: float) -> int:
        for a, z in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (value, v)):
            a.append(z)
        return len(value) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, lo: float, hi: float, level: int) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        me = node(float(np.clip(-gs / (hs + lam), lo, hi)))
        if level == depth or len(rows) < 2 * least:
            value[me] *= rate
            return me
        flat = (b[rows] + offset).ravel()
        k = x.shape[1] * bins
        hist = [np.bincount(flat, weights=np.repeat(w, x.shape[1]), minlength=k).reshape(-1, bins).cumsum(1) for w in (g[rows], h[rows], np.ones(len(rows)))]
        gl, hl, cl = hist
        gr, hr, cr = gs - gl, hs - hl, len(rows) - cl
        vl, vr = np.clip(-gl / (hl + lam), lo, hi), np.clip(-gr / (hr + lam), lo, hi)
        gain = -(gl * vl + 0.5 * (hl + lam) * vl**2 + gr * vr + 0.5 * (hr + lam) * vr**2)
        own = -(gs * value[me] + 0.5 * (hs + lam) * value[me] ** 2)
        bad = (cl < least) | (cr < least) | ((vr - vl) * signs[:, None] < 0)
        gain = np.where(bad, -np.inf, gain - own)
        j, c = np.unravel_index(int(gain.argmax()), gain.shape)
        if not gain[j, c] > 1e-6 or c >= len(cuts[j]):
            value[me] *= rate
            return me
        goes = b[rows, j] <= c
        mid = float(vl[j, c] + vr[j, c]) / 2
        l_lim, r_lim = ((lo, mid), (mid, hi)) if signs[j] > 0 else ((mid, hi), (lo, mid)) if signs[j] < 0 else ((lo, hi), (lo, hi))
        feature[me], cut[me] = int(j), float(cuts[j][c])
        left[me] = grow(rows[goes], g, h, *l_lim, level + 1)
        right[me] = grow(rows[~goes], g, h, *r_lim, level + 1)
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(grow(np.arange(n), g, h, -np.inf, np.inf, 0))
        one = Trees(*(np.array(a) for a in (feature, cut, left, right, value)), np.array(roots[-1:]), depth, 0.0)
        f = f + one.margin(x)
    return Trees(np.array(feature), np.array(cut, np.float32), np.array(left), np.array(right), np.array(value), np.array(roots), depth, base)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


def fit(stats: DataFrame, labels: DataFrame, rule: Column, limit: int = FIT_ROWS) -> Trees:
    x, y = labelled_sample(stats, labels, "quality", rule, limit)
    return boost(x, y, np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def judge(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """Counts, margin of the trees (None without trees), base_failed and kept for every row of docs."""
    runtime.ship(docs.sparkSession)
    stats = runtime.stored(document_stats(docs))
    bc = docs.sparkSession.sparkContext.broadcast(fit(stats, labels, learn))  # fixed size

    def run(it):
        for pdf in it:
            trees = bc.value
            m = trees.margin(np.stack(pdf.pop("stats").to_numpy())) if len(pdf) and len(trees.roots) else np.zeros(len(pdf))
            yield pdf.drop(columns="stats", errors="ignore").assign(margin=m.astype(float))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema if f.name != "stats")
    out = stats.mapInPandas(run, f"{fields}, margin double")
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("margin") >= 0))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (runtime.read(spark, sf_dir, t) for t in ("documents", "labels"))
    return judge(docs, labels, runtime.remainder("doc_id", 3) != 1).select("doc_id", *COUNTS, "base_failed", "kept", "margin")
