"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

The statistics of each document are standardised and sent through random
Fourier features, which approximate a Gaussian kernel.  Each partition of the
labelled rows sums its part of Z'Z and Z'y; the parts are added and solved for
ridge weights.  A fifth of the labelled rows, kept out of the fit, calibrates
the scores by isotonic regression (pool adjacent violators).

Defined results: null and empty texts are scored by their (zero) statistics;
repeated rows and ids are scored each; with no usable label, or with one class
only, every score is the (smoothed) share of label 1, 0.5 for no label at all;
an empty table gives an empty result.  Other columns of docs are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime
from .stats import FEATURES, document_stats, matrix, text_stats

FIT_ROWS = 40_000  # labelled rows that are learnt from, about
FIT_PARTS = 8


@dataclass
class RffModel:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray  # features x D/2
    beta: np.ndarray  # D + 1
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        p = np.clip((x - self.mean) / self.scale, -8, 8).astype(np.float32) @ self.w
        return np.concatenate([np.cos(p), np.sin(p), np.ones((len(p), 1), np.float32)], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), self.values[0])
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block means of y that don't fall as the score rises, as knots and values."""
    at, where = np.unique(score, return_inverse=True)
    weight = np.bincount(where).astype(float)
    value = np.bincount(where, weights=y) / weight
    blocks: list[list[float]] = []
    for lo, w, v in zip(at, weight, value, strict=True):
        blocks.append([v, w, lo, lo])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, _, hi = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[3] = (b[0] * b[1] + v2 * w2) / (b[1] + w2), b[1] + w2, hi
    knots = np.array([k for b in blocks for k in ((b[2], b[3]) if b[3] > b[2] else (b[2],))])
    values = np.array([b[0] for b in blocks for _ in range(2 if b[3] > b[2] else 1)])
    return knots, values


def fit(stats: DataFrame, labels: DataFrame, target: str, rule: Column, pairs: int = 128, ridge: float = 1e-3, seed: int = 7, limit: int = FIT_ROWS) -> RffModel:
    """Fit on about ``limit`` labelled rows for which ``rule`` (over doc_id) holds, chosen by the hash of their ids."""
    rows = runtime.learnable(stats, runtime.labels_of(labels, target, rule), limit).withColumn("k", F.xxhash64(F.col("doc_id").cast("string")))
    rows = runtime.cut(rows.repartition(FIT_PARTS, "k"))
    moments = rows.select(F.posexplode("stats"), "y").groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s"), F.count("*").alias("n"), F.avg("y").alias("y"), F.sum("y").alias("ones")).orderBy("pos").collect()
    d = len(FEATURES)
    if not moments or moments[0]["ones"] in (0, moments[0]["n"]):
        n, ones = (moments[0]["n"], moments[0]["ones"]) if moments else (0, 0)
        return RffModel(np.zeros(d), np.ones(d), np.zeros((d, pairs), np.float32), np.zeros(2 * pairs + 1), np.zeros(0), np.array([(ones + 1) / (n + 2)]))
    mean = np.array([r["m"] for r in moments], np.float32)
    scale = np.array([max(r["s"], 1e-6) for r in moments], np.float32)
    rng = np.random.default_rng(seed)
    w = (rng.standard_normal((d, pairs)) / (1.0 * np.sqrt(d))).astype(np.float32)
    model = RffModel(mean, scale, w, np.zeros(2 * pairs + 1), np.zeros(0), np.zeros(0))
    size = 2 * pairs + 1

    def sums(it):
        a, b = np.zeros((size, size)), np.zeros(size)
        for pdf in it:
            pdf = pdf[pdf["k"] % 5 != 0]
            if len(pdf):
                y = pdf["y"].to_numpy(float)
                # both classes weigh the same
                wt = np.where(y == 1, 0.5 / ones, 0.5 / (1 - ones))
                z = model.features(np.stack(pdf["stats"].to_numpy())).astype(float)
                a += (z * wt[:, None]).T @ z
                b += z.T @ (wt * (2 * y - 1))
        yield pd.DataFrame({"a": [a.tobytes()], "b": [b.tobytes()]})

    ones = float(moments[0]["y"])
    parts = rows.coalesce(FIT_PARTS).mapInPandas(sums, "a binary, b binary").collect()  # FIT_PARTS rows of fixed size
    a = sum(np.frombuffer(p["a"]).reshape(size, size) for p in parts)
    b = sum(np.frombuffer(p["b"]) for p in parts)
    model.beta = np.linalg.solve(a + ridge * max(np.trace(a) / size, 1e-9) * np.eye(size), b)
    # calibrated on the rows that the fit did not see; all rows if those have one class only
    held = rows.select("stats", "y", (F.col("k") % 5 == 0).alias("out")).toArrow()
    x, t, out = matrix(held["stats"]), held["y"].to_numpy(), held["out"].to_numpy(zero_copy_only=False)
    if len(set(t[out])) < 2:
        out = np.ones(len(t), bool)
    model.knots, model.values = isotonic(model.raw(x[out]), t[out].astype(float))
    return model


def score(stats: DataFrame, model: RffModel) -> DataFrame:
    """doc_id, score (0 to 1) of rows of document_stats."""
    bc = stats.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(it):
        for pdf in it:
            s = bc.value.score(np.stack(pdf["stats"].to_numpy())) if len(pdf) else np.zeros(0)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": s.astype(float)})

    return stats.select("doc_id", "stats").mapInPandas(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, learn: Column, target: str = "quality") -> DataFrame:
    """Score every row of docs; labels are learnt only from rows of docs where ``learn`` holds."""
    runtime.ship(docs.sparkSession)
    stats = runtime.stored(document_stats(docs).select("doc_id", "stats"))
    return score(stats, fit(stats, labels, target, learn))


def classify_rows(docs: DataFrame, labels: DataFrame, learn: Column, target: str = "quality") -> DataFrame:
    """docs with a score of each row, carried with the row: ids may be null or come twice. Fit as by ``classify``."""
    runtime.ship(docs.sparkSession)
    y = runtime.sampled(runtime.labels_of(labels, target, learn), ["doc_id"], FIT_ROWS).select("doc_id")
    own = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id", "left_semi")  # about FIT_ROWS ids
    bc = docs.sparkSession.sparkContext.broadcast(fit(document_stats(own).select("doc_id", "stats"), labels, target, learn))  # fixed size

    def run(it):
        for b in it:
            _, x = text_stats(b.column("text"))
            s = bc.value.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s.astype(float))], [*b.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (runtime.read(spark, sf_dir, t) for t in ("documents", "labels"))
    held = runtime.remainder("doc_id", 3) == 1
    out = classify(docs, labels, ~held)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
