"""Benchmark decontamination by winnowing.

Every run of SPAN words (a window) keeps the least of its hashed GRAM-grams as
its fingerprint, so that equal windows have equal fingerprints.  Windows of
the benchmark are rows (fingerprint, hash of the window it extends to).  The
documents' fingerprints are looked up in a Bloom filter of the benchmark's,
and only those that pass are extended to their windows, which are joined with
the benchmark's by fingerprint and window.  Hits add up to spans, as
neighbouring windows overlap.  An item of fewer words is one window, its own
fingerprint.

A window that a text repeats is one row with its places, and equal texts are
looked up once, so the work grows with the number of words and not with the
number of pairs of places.  Items that share the same windows are joined as
sets: the set's digest stands for its items until the end.

The filter has FILTER_BITS bits however large the benchmark is; it only spares
the shuffle, the join decides.

Defined results: a null or empty text has no words and no hits; items with a
null id, a null text or no word are ignored, an item id that comes twice
counts once; repeated rows are judged each; an empty benchmark hits nothing;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime
from . import textnp as tn

SPAN, GRAM = 13, 6
FILTER_BITS = 25  # 2**25 bits are 4 MB


def windows(w: tn.Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints, hashes and first words of the windows of n words."""
    at = w.window_starts(n)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), at
    h = w.hashes()
    whole = h if n == 1 else tn.rolling(h, n)
    if n < SPAN:
        return whole[at], whole[at], at
    g = tn.rolling(h, GRAM)
    low = g[: len(h) - SPAN + 1].copy()
    for k in range(1, SPAN - GRAM + 1):
        np.minimum(low, g[k : k + len(low)], out=low)
    return low[at], whole[at], at


def _bit(prints: np.ndarray, bits: int) -> np.ndarray:
    return (tn.mix(prints) >> np.uint64(64 - bits)).astype(np.int64)


def _batches(col: pa.Array):
    """Words of whole texts, A-Z lower-cased, part by part, with the parts' first and last rows."""
    data, offsets = tn.buffers(col)
    data = tn.LOWER[data]
    for a, b in tn.chunks(offsets):
        yield tn.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], tn.ALNUM), a, b


def index(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """Windows (n, fp, win, set) of the items, the items of each set (set, item), and the windows' lengths."""

    def run(it):
        for batch in it:
            for w, a, b in _batches(batch.column(1)):
                item = batch.column(0).slice(a, b - a)
                for n in range(1, SPAN + 1):
                    fp, win, at = windows(w, n)
                    ok = (w.count[w.doc[at]] == n) | (n == SPAN)
                    if ok.any():
                        _, one = np.unique(np.stack([win[ok], w.doc[at][ok].astype(np.uint64)], 1), axis=0, return_index=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(one), n, np.int32)), *(pa.array(x[ok][one].view(np.int64)) for x in (fp, win)), item.take(pa.array(w.doc[at][ok][one]))], ["n", "fp", "win", "item"])

    own = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    rows = runtime.stored(own.mapInArrow(run, "n int, fp long, win long, item string").distinct())
    # a set of items by count, sum and xor of hashes: no window's items are gathered
    h = F.xxhash64("item")
    keyed = rows.groupBy("n", "fp", "win").agg(F.sha2(F.concat_ws(" ", F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h), F.bit_xor(F.xxhash64("item", F.lit(1)))), 256).alias("set"))
    keyed = runtime.stored(keyed)
    one = keyed.groupBy("set").agg(F.min(F.struct("n", "fp", "win")).alias("w")).select("set", "w.*")
    items = rows.join(one, ["n", "fp", "win"]).select("set", "item")
    return keyed, items, sorted(r["n"] for r in keyed.select("n").distinct().collect())


def _filter(keyed: DataFrame, bits: int) -> np.ndarray:
    def run(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array(_bit(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits))], ["place"])

    words = keyed.select("fp").distinct().mapInArrow(run, "place long").groupBy(F.floor(F.col("place") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for b in words.toArrow().to_batches():  # at most 2**(bits - 6) rows
        out[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return out.view(np.uint64)


_FOUND = "n_words long, key binary, found array<struct<n: int, fp: long, win: long, at: binary>>"


def marked(docs: DataFrame, keyed: DataFrame, lengths: list[int]) -> DataFrame:
    """docs with n_words and, where a fingerprint may be the benchmark's, the text's digest (key) and its windows (found)."""
    runtime.ship(docs.sparkSession)
    bits = FILTER_BITS
    bloom = docs.sparkSession.sparkContext.broadcast(_filter(keyed, bits))  # fixed size
    names, text = docs.columns, docs.columns.index("text")
    kind = pa.list_(pa.struct([("n", pa.int32()), ("fp", pa.int64()), ("win", pa.int64()), ("at", pa.binary())]))

    def candidates(w: tn.Words):
        """For each text: its distinct windows that pass the filter."""
        out: dict[int, list] = {}
        for n in lengths:
            fp, win, at = windows(w, n)
            place = _bit(fp, bits)
            ok = np.flatnonzero((bloom.value[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1))
            if len(ok):
                doc = w.doc[at[ok]]
                by = np.lexsort((at[ok], win[ok], doc))
                ok, doc = ok[by], doc[by]
                edge = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (win[ok][1:] != win[ok][:-1])])
                for i, j in zip(edge, np.r_[edge[1:], len(ok)], strict=True):
                    places = (at[ok[i:j]] - w.first[doc[i]]).astype("<i4").tobytes()
                    out.setdefault(int(doc[i]), []).append({"n": n, "fp": int(fp[ok[i]].view(np.int64)), "win": int(win[ok[i]].view(np.int64)), "at": places})
        return out

    def run(it):
        for batch in it:
            n_words, key, found = [], [], []
            for w, a, b in _batches(batch.column(text).cast(pa.string())):
                n_words += w.count.tolist()
                got = candidates(w)
                for k in range(b - a):
                    own = got.get(k)
                    found.append(own)
                    key.append(hashlib.blake2b(w.data[w.offsets[k] : w.offsets[k + 1]].tobytes(), digest_size=16).digest() if own else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words, pa.int64()), pa.array(key, pa.binary()), pa.array(found, kind)], [*names, "n_words", "key", "found"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *T._parse_datatype_string(_FOUND).fields]))


def joined(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """(key, n, at, set) of the windows of marked rows that the benchmark holds; equal texts count once."""
    each = rows.where("key is not null").select("key", F.explode("found").alias("f")).select("key", "f.*")
    return each.join(keyed, ["n", "fp", "win"]).select("key", "n", "at", "set").distinct()


def _covered(it):
    for b in it:
        out = []
        for sizes, places in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            at = [np.frombuffer(x, "<i4").astype(np.int64) for x in places]
            length = np.repeat(sizes, [len(x) for x in at])
            at = np.concatenate(at)
            inside = tn.covered(int((at + length).max()), at, length).view(np.int8)
            edge = np.flatnonzero(np.diff(np.r_[0, inside, 0]))
            out.append(edge.tolist())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], ["key", "spans"])


def spans(found: DataFrame) -> DataFrame:
    """(key, spans: begin and end words of the maximal runs of hit words)."""
    own = found.select("key", "n", "at").distinct().groupBy("key").agg(F.collect_list(F.struct("n", "at")).alias("w")).select("key", F.col("w.n").alias("n"), F.col("w.at").alias("at"))
    return own.mapInArrow(_covered, "key binary, spans array<int>")


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, spans: begin and end words, items) for every row of docs."""
    runtime.ship(docs.sparkSession)
    keyed, items, lengths = index(benchmark)
    rows = runtime.stored(marked(docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text")), keyed, lengths).drop("text"))
    found = runtime.stored(joined(rows, keyed))
    names = found.select("key", "set").distinct().join(items, "set").select("key", "item").distinct().groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    both = spans(found).join(names, "key")
    hit = rows.where("key is not null").join(both, "key", "left")  # the others have no hits: only candidates are shuffled
    none = [F.expr("cast(array() as array<int>)"), F.expr("cast(array() as array<string>)")]
    plain = rows.where("key is null").select("doc_id", "n_words", none[0].alias("spans"), none[1].alias("items"))
    return plain.union(hit.select("doc_id", "n_words", F.coalesce("spans", none[0]), F.coalesce("items", none[1])))


def n_hit(of: str = "spans"):
    """Words within spans."""
    return F.aggregate(F.transform(of, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated(hit, words):
    return (hit > 0) & (F.lit(20) * hit >= words)


def digest(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated of rows of hits."""
    out = found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", contaminated(F.col("n_hit"), F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, whatever else their columns are called; texts are not shuffled while few of them are."""
    runtime.ship(docs.sparkSession)
    keyed, _, lengths = index(benchmark)
    inner = {c: f"_{k}" for k, c in enumerate(docs.columns) if c != "text"}  # no clash with the columns that are added
    rows = marked(docs.withColumnsRenamed(inner), keyed, lengths)
    some = runtime.stored(rows.where("key is not null").select("n_words", "key", "found"))  # few, without texts
    found = spans(joined(some, keyed)).join(some.select("key", "n_words").distinct(), "key")
    bad = found.where(contaminated(n_hit(), F.col("n_words"))).select("key")
    kept = runtime.without(rows.drop("n_words", "found"), bad, ["key"]).drop("key")
    return kept.withColumnsRenamed({v: k for k, v in inner.items()}).select(*docs.columns)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(hits(runtime.read(spark, sf_dir, "documents"), runtime.read(spark, sf_dir, "benchmark")))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
