"""Substring deduplication with suffix automata of reference shards.

A window is LENGTH consecutive words of a document.  Every word that lies in a
window whose words also start earlier (in a smaller id, or further to the
front of the same document) is removed; windows are judged on the input.

1. Candidates.  Each window has an anchor, the 6-gram of least hash inside it.
   Tasks put their windows' hashes into buckets by anchor, each distinct window
   once for some FLUSH windows, so that frequent passages shrink before they are
   shuffled; windows of a frequent anchor are dealt by their own hash.  A
   bucket finds the windows that come more than once; the first one is the
   reference, the others refer to its document.
2. Shards.  Reference spans (runs of first windows) and the spans that refer to
   them meet in small shards, by the reference's document; spans that refer
   to a document of very many claims are dealt over copies of its references.
   Each shard builds the suffix automaton of its references' words and streams
   the other spans through it: where the matching statistic reaches LENGTH, the
   words are removed.  Words are compared as they are, hashes only nominate.
3. The removed ranges go back to the documents' texts.

Defined results: a null or empty text has no words; ids must be integers, a
row with a null id keeps all its words and is no reference; rows that repeat
an id with another text are documents of their own, one after the other in the
order of their texts' hashes; exact repeats get the same result, and don't
count as earlier; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from . import textnp as tn

LENGTH, ANCHOR = 20, 6
FLUSH = 300_000  # windows that a task holds before it hands them on
BUCKET_BYTES, SHARD_BYTES = 4_000_000, 2_000_000  # text for each bucket and shard
SALT_AT = 8192  # claims on one document for each copy of its references
CELLS = 1 << 16  # cells of the table of copies
HOT_WINDOWS, HOT_SHARE, HOT_BITS = 100_000, 16, 22  # windows of a frequent anchor; of how many documents one is counted; bits of its place in the table
_LOW40 = np.uint64((1 << 40) - 1)


def anchors(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the anchor of the windows that start at ``at``."""
    g = tn.rolling(h, ANCHOR)
    low = g[: len(h) - LENGTH + 1].copy()
    for k in range(1, LENGTH - ANCHOR + 1):
        np.minimum(low, g[k : k + len(low)], out=low)
    return low[at]


def _runs(doc: np.ndarray, start: np.ndarray, *also: np.ndarray) -> np.ndarray:
    """First places of the runs of consecutive windows of a document (with equal values of the other columns)."""
    if not len(doc):
        return np.zeros(0, np.int64)
    new = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    for a in also:
        new |= a[1:] != a[:-1]
    return np.r_[0, np.flatnonzero(new) + 1]


def ranks(doc: np.ndarray, ver: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of each (doc, ver) in their order, and the distinct ones in that order."""
    by = np.lexsort((ver, doc))
    d, v = doc[by], ver[by]
    new = np.r_[True, (d[1:] != d[:-1]) | (v[1:] != v[:-1])] if len(d) else np.zeros(0, bool)
    out = np.zeros(len(doc), np.int64)
    out[by] = np.cumsum(new) - 1
    return out, d[new], v[new]


CLAIM = np.dtype([("start", "<i4"), ("n", "<i4"), ("owner", "<i8"), ("over", "<i8")])
REF = np.dtype([("start", "<i4"), ("n", "<i4")])
RUN = np.dtype([("doc", "<i8"), ("ver", "<i8"), ("start", "<i4"), ("n", "<i4"), ("tag", "<u4")])


def judge(key: np.ndarray, rank: np.ndarray, start: np.ndarray, doc: np.ndarray, ver: np.ndarray) -> tuple[np.ndarray, list]:
    """Of windows (key, rank of the document, start): which are the first of their key, and spans that refer to others or are referred to.

    doc, ver: the documents by rank.  The spans are given by document, as (doc, ver, packed claims, packed references).
    """
    order = np.argsort(key, kind="stable")
    k = key[order]
    edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    size = np.diff(np.r_[edge, len(k)])
    first = np.zeros(len(key), bool)
    first[order[edge[size == 1]]] = True
    many = order[np.repeat(size > 1, size)]
    if not len(many):
        return first, []
    many = many[np.lexsort((start[many], rank[many], key[many]))]
    k = key[many]
    head = np.r_[True, k[1:] != k[:-1]]
    group = np.cumsum(head) - 1
    owner = many[head]
    first[owner] = True
    # an exact repeat of a row has its windows at the very same place: not earlier, so neither is removed
    o_rank, o_start = rank[owner][group], start[owner][group]
    rest = ~head & ((rank[many] != o_rank) | (start[many] != o_start))
    d, s, o = rank[many][rest], start[many][rest], o_rank[rest]
    by = np.lexsort((s, d))
    d, s, o = d[by], s[by], o[by]
    keep = np.r_[True, (d[1:] != d[:-1]) | (s[1:] != s[:-1])] if len(d) else np.zeros(0, bool)
    d, s, o = d[keep], s[keep], o[keep]
    at = _runs(d, s, o)
    claims = np.zeros(len(at), CLAIM)
    claims["start"], claims["owner"], claims["over"] = s[at], doc[o[at]], ver[o[at]]
    claims["n"] = np.diff(np.r_[at, len(d)])
    r_rank, r_start = rank[owner], start[owner]
    by = np.lexsort((r_start, r_rank))
    r_rank, r_start = r_rank[by], r_start[by]
    ra = _runs(r_rank, r_start)
    refs = np.zeros(len(ra), REF)
    refs["start"], refs["n"] = r_start[ra], np.diff(np.r_[ra, len(r_rank)])
    out = []
    for who, packed, kind in ((d[at], claims, 0), (r_rank[ra], refs, 1)):
        if len(who):
            edge = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            for i, j in zip(edge, np.r_[edge[1:], len(who)], strict=True):
                raw = packed[i:j].tobytes()
                out.append((int(doc[who[i]]), int(ver[who[i]]), raw if kind == 0 else b"", raw if kind == 1 else b""))
    return first, out


NOMINATED = "bucket int, blob binary, doc long, ver long, claims binary, refs binary"


def _rows(bucket, blob, spans) -> pa.RecordBatch:
    """Rows of blobs, then rows of spans (dealt over the buckets)."""
    n, m = len(bucket), len(spans)
    own = [pa.array([*[None] * n, *[x[k] for x in spans]], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
    return pa.RecordBatch.from_arrays([pa.array([*bucket, *[d & 0x7FFFFFFF for d, *_ in spans]], pa.int32()), pa.array([*blob, *[None] * m], pa.binary()), *own], [x.split()[0] for x in NOMINATED.split(", ")])


def _texts(it):
    """Words of the texts of rows (doc, ver, text), part by part, with the parts' ids and versions."""
    for batch in it:
        ids, vers = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        data, offsets = tn.buffers(batch.column(2))
        for a, b in tn.chunks(offsets):
            yield tn.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), ids[a:b], vers[a:b]


def _frequent(own: DataFrame) -> np.ndarray:
    """A table of 2**HOT_BITS bits that marks the anchors of too many windows for one bucket, as counted in one of HOT_SHARE documents.

    It only says how windows are dealt to buckets: an anchor marked by chance, or missed, changes no result.
    """

    def run(it):
        for w, _, _ in _texts(it):
            at = w.window_starts(LENGTH)
            if len(at):
                a, n = np.unique(anchors(w.hashes(), at), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])

    some = own.where(F.pmod(F.xxhash64("doc", "ver"), F.lit(HOT_SHARE)) == 0).mapInArrow(run, "anchor long, n long")
    hot = some.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") * HOT_SHARE > HOT_WINDOWS)
    place = F.shiftrightunsigned("anchor", 64 - HOT_BITS)
    words = hot.select(place.alias("place")).groupBy(F.floor(F.col("place") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
    out = np.zeros(1 << (HOT_BITS - 6), np.int64)
    for r in words.collect():  # at most 2**(HOT_BITS - 6) rows
        out[r["w"]] = r["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _nominate(buckets: int, hot):
    def flush(parts: list, docs: list) -> pa.RecordBatch:
        key, anchor, row, start = (np.concatenate([p[k] for p in parts]) for k in range(4))
        place, doc, ver = ranks(*(np.concatenate([d[k] for d in docs]) for k in (0, 1)))
        rank = place[row]
        first, spans = judge(key, rank, start, doc, ver)
        key, anchor, rank, start = key[first], anchor[first], rank[first], start[first]
        often = hot.value[(anchor >> np.uint64(64 - HOT_BITS)).astype(np.int64)]
        bucket = ((np.where(often, tn.mix(key), anchor) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        by = np.lexsort((start, rank, bucket))
        key, anchor, rank, start, bucket = key[by], anchor[by], rank[by], start[by], bucket[by]
        tag = (anchor & np.uint64(0xFFFFFF)).astype(np.uint32)
        at = _runs(rank, start, bucket, tag)
        runs = np.zeros(len(at), RUN)
        runs["doc"], runs["ver"], runs["start"], runs["tag"], runs["n"] = doc[rank[at]], ver[rank[at]], start[at], tag[at], np.diff(np.r_[at, len(rank)])
        low, high = (key & np.uint64(0xFFFFFFFF)).astype("<u4"), ((key >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8)
        out, blobs = [], []
        run_bucket = bucket[at]
        for b in np.unique(bucket).tolist():  # only buckets that have windows
            lo, hi = np.searchsorted(bucket, [b, b + 1])
            r = runs[slice(*np.searchsorted(run_bucket, [b, b + 1]))]
            out.append(b)
            blobs.append(np.int64(len(r)).tobytes() + r.tobytes() + low[lo:hi].tobytes() + high[lo:hi].tobytes())
        return _rows(out, blobs, spans)

    def run(it):
        parts, docs, held, rows = [], [], 0, 0
        for w, ids, vers in _texts(it):
            key, at = w.grams(LENGTH)
            if len(at):
                parts.append((key, anchors(w.hashes(), at), rows + w.doc[at], (at - w.first[w.doc[at]]).astype(np.int32)))
                docs.append((ids, vers))
                held, rows = held + len(at), rows + len(ids)
            if held >= FLUSH:
                yield flush(parts, docs)
                parts, docs, held, rows = [], [], 0, 0
        if parts:
            yield flush(parts, docs)

    return run


def _bucket(t: pa.Table) -> pa.Table:
    """Windows of a bucket that come more than once, as spans by document; spans that came along pass through."""
    through = [x for x in zip(*(t[c].to_pylist() for c in ("doc", "ver", "claims", "refs")), strict=True) if x[0] is not None]
    runs, low, high = [], [], []
    for blob in t["blob"].to_pylist():
        if blob is not None:
            n = int(np.frombuffer(blob, np.int64, 1)[0])
            r = np.frombuffer(blob, RUN, n, 8)
            size, at = int(r["n"].sum()), 8 + n * RUN.itemsize
            runs.append(r)
            low.append(np.frombuffer(blob, "<u4", size, at))
            high.append(np.frombuffer(blob, np.uint8, size, at + 4 * size))
    spans = []
    if runs:
        r = np.concatenate(runs)
        n = r["n"].astype(np.int64)
        key = np.concatenate(low).astype(np.uint64) | (np.concatenate(high).astype(np.uint64) << np.uint64(32)) | (np.repeat(r["tag"], n).astype(np.uint64) << np.uint64(40))
        start = (np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(r["start"], n)).astype(np.int32)
        place, doc, ver = ranks(r["doc"], r["ver"])
        _, spans = judge(key, np.repeat(place, n), start, doc, ver)
    spans += through
    return pa.table({c: pa.array([s[k] for s in spans], kind) for k, (c, kind) in enumerate((("doc", pa.int64()), ("ver", pa.int64()), ("claims", pa.binary()), ("refs", pa.binary())))})


def _pieces(x: np.ndarray, *same: str) -> list[tuple[int, int]]:
    """Ranges of sorted spans that touch and agree in the named fields."""
    if not len(x):
        return []
    new = x["start"][1:] > x["start"][:-1] + x["n"][:-1]
    for f in same:
        new |= x[f][1:] != x[f][:-1]
    at = np.flatnonzero(np.r_[True, new]).tolist()
    return list(zip(at, [*at[1:], len(x)], strict=True))


def _name(doc, ver) -> np.ndarray:
    """One hash of each (doc, ver)."""
    return tn.mix(np.atleast_1d(np.asarray(doc, np.int64)).view(np.uint64) ^ tn.mix(np.atleast_1d(np.asarray(ver, np.int64)).view(np.uint64)))


def _copies(by_doc: DataFrame) -> np.ndarray:
    """How many copies of its references a document needs, by cell of its name: one for every SALT_AT claims on it.

    The claims are counted for each document; a cell takes the most of those that share it, so that others may get copies in vain.
    """

    def run(it):
        for b in it:
            c = np.frombuffer(b"".join(x for row in b.column(0).to_pylist() for x in row), CLAIM)
            if len(c):
                place, doc, ver = ranks(c["owner"].astype(np.int64), c["over"].astype(np.int64))
                cell = (_name(doc, ver) >> np.uint64(40)).astype(np.int64) % CELLS
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(ver), pa.array(cell), pa.array(np.bincount(place).astype(np.int64))], ["doc", "ver", "cell", "n"])

    counted = by_doc.select("claims").mapInArrow(run, "doc long, ver long, cell long, n long").groupBy("doc", "ver", "cell").agg(F.sum("n").alias("n")).where(F.col("n") > SALT_AT)
    out = np.ones(CELLS, np.int64)
    for r in counted.groupBy("cell").agg(F.max("n").alias("n")).collect():  # at most CELLS rows
        out[r["cell"]] = -(-r["n"] // SALT_AT)
    return out


def _spans(shards: int, copies):
    """Rows of (doc, ver, text, claims, refs) to the texts of spans, by shard."""

    def run(it):
        for batch in it:
            out = []
            for doc, ver, text, claims, refs in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                words = (text or "").encode().split()
                own = int(_name(doc, ver)[0])
                c = np.frombuffer(b"".join(claims), CLAIM)
                c = c[np.argsort(c["start"], kind="stable")]
                name = _name(c["owner"].astype(np.int64), c["over"].astype(np.int64)) if len(c) else []
                for a, b in _pieces(c, "owner", "over"):
                    lo, hi = int(c["start"][a]), int((c["start"][a:b] + c["n"][a:b]).max()) + LENGTH - 1
                    to = int(name[a])
                    out.append((to % shards, own % int(copies.value[(to >> 40) % CELLS]), doc, ver, lo, b" ".join(words[lo:hi])))
                r = np.frombuffer(b"".join(refs), REF)
                r = r[np.argsort(r["start"], kind="stable")]
                for a, b in _pieces(r):
                    lo, hi = int(r["start"][a]), int((r["start"][a:b] + r["n"][a:b]).max()) + LENGTH - 1
                    for salt in range(int(copies.value[(own >> 40) % CELLS])):
                        out.append((own % shards, salt, doc, ver, -1 - lo, b" ".join(words[lo:hi])))
            if out:
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["shard", "salt", "doc", "ver", "at", "words"])

    return run


class SuffixAutomaton:
    """The suffix automaton of sequences of words (any hashable symbols); no match runs over two sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def add(self, words) -> None:
        for w in words:
            self._extend(w)
        self._extend(object())  # a separator that no text holds

    def _extend(self, w) -> None:
        nxt, link, length = self.next, self.link, self.length
        cur, p = len(nxt), self.last
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def matches(self, words, least: int) -> list[tuple[int, int]]:
        """Maximal ranges of words that matches of ``least`` words or more cover."""
        nxt, link, length = self.next, self.link, self.length
        v = l = 0  # noqa: E741
        out: list[tuple[int, int]] = []
        for i, w in enumerate(words, 1):
            while v and w not in nxt[v]:
                v = link[v]
                l = length[v]  # noqa: E741
            if w in nxt[v]:
                v = nxt[v][w]
                l += 1  # noqa: E741
            if l >= least:
                if out and out[-1][1] >= i - l:
                    out[-1] = (min(out[-1][0], i - l), i)
                else:
                    out.append((i - l, i))
        return out


def _shard(t: pa.Table) -> pa.Table:
    """Stream a shard's spans through the automaton of its references; (doc, ver, begin, end) of what is removed."""
    sam, spans = SuffixAutomaton(), []
    rows = list(zip(*(t[c].to_pylist() for c in ("doc", "ver", "at", "words")), strict=True))
    for _, _, at, words in rows:
        if at < 0:
            spans.append(words)
    for words in dict.fromkeys(spans):
        sam.add(words.split())
    known: dict[bytes, list[tuple[int, int]]] = {}
    out = []
    for doc, ver, at, words in rows:
        if at >= 0:
            if words not in known:
                known[words] = sam.matches(words.split(), LENGTH)
            out += [(doc, ver, at + a, at + b) for a, b in known[words]]
    cols = zip(*out, strict=True) if out else [[]] * 4
    return pa.table({c: pa.array(x, k) for c, x, k in zip(("doc", "ver", "begin", "end"), cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)})


def removed(own: DataFrame) -> DataFrame:
    """(doc, ver, ranges: array of begin and end words) of the documents (doc, ver, text) that lose words."""
    spark = own.sparkSession
    runtime.ship(spark)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, shards = max(4, -(-size // BUCKET_BYTES)), max(4, -(-size // SHARD_BYTES))
    hot = spark.sparkContext.broadcast(_frequent(own))  # fixed size
    nominated = own.mapInArrow(_nominate(buckets, hot), NOMINATED).withColumn("bucket", F.pmod("bucket", F.lit(buckets)))
    spans = nominated.groupBy("bucket").applyInArrow(lambda t: _bucket(t), "doc long, ver long, claims binary, refs binary")
    by_doc = runtime.stored(spans.groupBy("doc", "ver").agg(F.collect_list("claims").alias("claims"), F.collect_list("refs").alias("refs")))
    copies = spark.sparkContext.broadcast(_copies(by_doc))  # fixed size
    texts = own.join(by_doc, ["doc", "ver"]).select("doc", "ver", "text", "claims", "refs").mapInArrow(_spans(shards, copies), "shard int, salt int, doc long, ver long, at int, words binary")
    found = texts.groupBy("shard", "salt").applyInArrow(lambda t: _shard(t), "doc long, ver long, begin int, end int")
    return found.distinct().groupBy("doc", "ver").agg(F.collect_list(F.array("begin", "end")).alias("ranges"))


def _own(docs: DataFrame, id_col: str) -> DataFrame:
    """(doc, ver: the text's hash, text) of the rows with an id."""
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("ver"), F.col("text").cast("string").alias("text")).where("doc is not null")


def _apply(form, fields: str):
    def run(it):
        for batch in it:
            out = []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                if ranges:
                    e = np.array(ranges)
                    gone = tn.covered(len(words), np.minimum(e[:, 0], len(words)), np.minimum(e[:, 1], len(words)) - np.minimum(e[:, 0], len(words)))
                    kept = [words[k] for k in np.flatnonzero(~gone)]
                else:
                    kept = words
                out.append(form(words, kept))
            cols = list(zip(*out, strict=True)) or [[] for _ in fields.split(", ")]
            kinds = {"long": pa.int64(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kinds[f.split()[1]]) for c, f in zip(cols, fields.split(", "), strict=True))], ["doc", *(f.split()[0] for f in fields.split(", "))])

    return run


def apply(docs: DataFrame, form, fields: str, id_col: str = "doc_id") -> DataFrame:
    """form(words, kept words) of every row, as the named fields."""
    none, own = F.expr("cast(array() as array<array<int>>)"), _own(docs, id_col)
    with_ids = own.join(removed(own), ["doc", "ver"], "left").select("doc", "text", F.coalesce("ranges", none).alias("ranges"))
    without = docs.where(F.col(id_col).cast("long").isNull()).select(F.lit(None).cast("long").alias("doc"), F.col("text").cast("string").alias("text"), none.alias("ranges"))
    return with_ids.union(without).mapInArrow(_apply(form, fields), f"doc long, {fields}")


def deduplicate(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with the kept words, joined by one space, as text; texts that lose nothing stay as they are, as do all other columns."""
    own = docs.schema

    def run(it):
        at = own.fieldNames().index("text")
        for batch in it:
            text = []
            for t, ranges in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if t and ranges:
                    words = t.encode().split()
                    gone = np.zeros(len(words), bool)
                    for a, b in ranges:
                        gone[a:b] = True
                    t = b" ".join([words[k] for k in np.flatnonzero(~gone)]).decode() if gone.any() else t
                text.append(t)
            cols = batch.columns[:-1]
            cols[at] = pa.array(text, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(cols, own.fieldNames())

    ranges = removed(_own(docs, id_col)).select(F.col("doc").alias("_doc"), F.col("ver").alias("_ver"), F.col("ranges").alias("_ranges"))
    same = (F.col(id_col).cast("long") == F.col("_doc")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_ver"))
    return docs.join(ranges, same, "left").select(*own.fieldNames(), "_ranges").mapInArrow(run, own)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = lambda words, kept: (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return apply(runtime.read(spark, sf_dir, "documents"), form, "n_words long, n_removed long, kept_sha256 string").withColumnRenamed("doc", "doc_id")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM late)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
