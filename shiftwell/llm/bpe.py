"""Byte-level BPE, encoding and decoding, with a minimal acyclic transducer of frequent words.

The most frequent pre-tokens of the corpus (counted over all documents) are
compiled, with their ids as outputs, into a minimal acyclic automaton that
shares prefixes and suffixes.  Each arc adds a number, the sum over a word's
path is its place in the table of outputs.  The arrays travel as one file that
every worker maps into memory.  Words outside the lexicon are merged exactly,
by merge rank; the ids never depend on what the lexicon holds.

Texts are cut at the special tokens first and then by the byte-level pattern,
as the tokenizers library does without adding special tokens, truncation or
padding.  Portions of texts are cut at once, as arrays of bytes: the pattern
depends on four kinds of characters only, which the library tells.  Only the
distinct words of a portion walk through the automaton; their ids, and the bytes
of all ids when decoding, are gathered by Arrow.

Defined results: a null text is encoded as the empty text (no ids); repeated
rows are encoded each; an empty table gives an empty result.  A text that is no
valid UTF-8 is an error.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from . import runtime

#: The byte-level pattern; ``Vocabulary.starts`` finds its matches.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")  # the pattern's endings behind an apostrophe
LETTER, NUMBER, OTHER, BLANK, UNKNOWN = range(5)  # kinds of characters
_SPLITTER = pre_tokenizers.ByteLevel(add_prefix_space=False)
LEXICON = 50_000  # words compiled into the transducer, at most
TABLE = 100_000  # words that a task counts at once, at most
LONG = 256  # longer pre-tokens are merged one by one
NONE = 1 << 30  # the rank of pairs that don't merge
PORTION = 4 << 20  # bytes of text that are cut at once, or one longer text
BLOCK = 1 << 16  # words outside the lexicon that are merged in step, at most


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, k in vocab.items():
            self.bytes[k] = bytes(letters[c] for c in token)
        for token, k in self.special.items():
            self.bytes[k] = token.encode()
        self.single = [0] * 256
        for c, b in letters.items():
            self.single[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        #: pair of ids -> rank and merged id
        self.merges = {(vocab[a] << 20) | vocab[b]: (rank << 20) | vocab[a + b] for rank, (a, b) in reversed(list(enumerate(merges)))}
        self.tokens = pa.array(self.bytes, pa.large_binary())
        self.marks = {t.encode(): k for t, k in self.special.items()}
        names = sorted(self.marks, key=len, reverse=True)
        self.cut = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)  # of code points, as far as they have occurred
        self.plain = np.zeros(256, np.uint8)
        self.plain[:128] = self._kinds(np.arange(128))
        pairs = sorted(self.merges.items())
        self.pair, ranked = np.array([p for p, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64)
        self.pair_rank = ranked >> 20
        self.merged = np.zeros(len(merges) + 1, np.int64)  # by rank
        self.merged[self.pair_rank] = ranked & 0xFFFFF
        self.letter = np.array(self.single, np.int64)
        self.letter_rank = self._rank(np.repeat(self.letter, 256), np.tile(self.letter, 256))

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        """Kinds of code points: the pattern's classes are those of the tokenizers library's Unicode version, so it is asked."""
        found = self.kinds[points]
        if (found == UNKNOWN).any():
            for p in np.unique(points[found == UNKNOWN]).tolist():
                joins = [len(_SPLITTER.pre_tokenize_str(c + chr(p))) == 1 for c in "a1!"]
                self.kinds[p] = joins.index(True) if any(joins) else BLANK
            found = self.kinds[points]
        return found

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids."""
        if not len(self.pair):
            return np.full(len(a), NONE)
        want = a << 20 | b
        k = np.minimum(np.searchsorted(self.pair, want), len(self.pair) - 1)
        return np.where(self.pair[k] == want, self.pair_rank[k], NONE)

    def ids_of(self, words: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """Ids of words, packed; exact: in each round, every word merges its pair of the lowest rank, the first of equal ones."""
        first, data = _parts(words)
        size = np.diff(first)
        own = pc.is_in(words, value_set=pa.array(list(self.marks), pa.large_binary())).to_numpy(zero_copy_only=False) | (size > LONG)
        out, kept = np.zeros(len(data), np.uint32), np.zeros(len(data), bool)
        for k in np.flatnonzero(own).tolist():
            ids = self.ids(words[k].as_py())
            out[first[k] : first[k] + len(ids)], kept[first[k] : first[k] + len(ids)] = ids, True
        size = np.where(own, 0, size)
        at = np.flatnonzero(np.repeat(~own, np.diff(first)))  # where an id begins
        size = size[size > 0]
        ids = self.letter[data[at]]
        rank = np.full(len(at), NONE)
        rank[:-1] = self.letter_rank[data[at[:-1]].astype(np.int64) << 8 | data[at[1:]]]
        rank[np.cumsum(size) - 1] = NONE
        while len(size):
            ends = np.cumsum(size)
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), ends - size)
            live = best < NONE << 32
            keep = np.repeat(live, size)
            if not live.all():
                done = at[~keep]
                out[done], kept[done] = ids[~keep], True
            k = best[live] & 0xFFFFFFFF
            ids[k] = self.merged[best[live] >> 32]
            head, tail = k == (ends - size)[live], k + 2 == ends[live]
            keep[k + 1] = False
            k = np.cumsum(keep)[k] - 1
            at, ids, rank, size = at[keep], ids[keep], rank[keep], size[live] - 1
            rank[k[tail]] = NONE
            m = k[~tail]
            rank[m] = self._rank(ids[m], ids[m + 1])
            m = k[~head]
            rank[m - 1] = self._rank(ids[m - 1], ids[m])
        return _binary(4 * np.append(0, np.cumsum(kept))[first], out[kept].view(np.uint8))

    def ids(self, word: bytes) -> list[int]:
        """Ids of a word as ``starts`` cuts them: a special token or a pre-token."""
        return [self.marks[word]] if word in self.marks else self.merge(word)

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: always the pair of the lowest rank, from the left."""
        ids = [self.single[b] for b in word]
        if len(ids) > LONG:
            return self._merge_long(ids)
        get = self.merges.get
        none = 1 << 60
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            new = ids[k] = best & 0xFFFFF
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << 20 | new, none)
            if k < len(ranks):
                ranks[k] = get(new << 20 | ids[k + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for very long pre-tokens."""
        import heapq

        n = len(ids)
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        get = self.merges.get
        heap = [(m >> 20, k, m & 0xFFFFF, ids[k], ids[k + 1]) for k in range(n - 1) if (m := get(ids[k] << 20 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, new, a, b = heapq.heappop(heap)
            j = nxt[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = new, -1
            nxt[k] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = k
            nxt[j] = -1
            for p in (prv[k], k):
                if p >= 0 and nxt[p] >= 0 and (m := get(ids[p] << 20 | ids[nxt[p]])) is not None:
                    heapq.heappush(heap, (m >> 20, p, m & 0xFFFFF, ids[p], ids[nxt[p]]))
        return [i for i in ids if i >= 0]

    def starts(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where the words (special tokens and pre-tokens) start in texts of UTF-8 that lie behind each other; first: where each text starts, and the end."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64)
        begin = np.zeros(n + 1, bool)  # texts and stretches between special tokens
        begin[first] = True
        spans: list[tuple[int, int]] = []
        raw = data.tobytes() if self.cut is not None else b""
        if any(m in raw for m in self.marks):
            spans = [m.span() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True) for m in self.cut.finditer(raw, a, b)]
        for a, b in spans:
            begin[a] = begin[b] = True
        kind = self.plain[data]
        wide, ends = (np.zeros(0, np.int64),) * 2  # blanks of several bytes
        if data.max() >= 0x80:
            lead = np.flatnonzero(data >= 0xC0)
            head = data[lead].astype(np.int32)
            size = 2 + (head >= 0xE0) + (head >= 0xF0)
            point = head & (0x7F >> size)
            for k in range(1, 4):
                more = size > k
                point[more] = point[more] << 6 | data[lead[more] + k] & 0x3F
            found = self._kinds(point)
            kind[lead] = found
            for k in range(1, 4):
                more = size > k
                kind[lead[more] + k] = found[more]
            wide = lead[found == BLANK]
            ends = wide + size[found == BLANK] - 1
        new = begin[:n].copy()
        new[1:] |= kind[1:] != kind[:-1]
        blank = kind == BLANK
        behind = np.zeros(n, bool)  # blanks with something else behind them in the text
        behind[:-1] = blank[:-1] & ~(blank[1:] | begin[1:n])
        # a space belongs to what is behind it, and any such blank is parted from the blanks before it
        new[1:] &= ~(behind[:-1] & (data[:-1] == 0x20))
        moved = behind[ends]
        behind[ends] = False
        behind[wide] |= moved
        new |= behind
        mark = np.flatnonzero(data == 0x27)
        mark = mark[new[mark]]
        for x in SHORT:
            at = mark[mark + len(x) < n]
            for k, byte in enumerate(x, 1):
                at = at[(data[at + k] == byte) & ~begin[at + k]]
            new[at + 1] = False
            at = at[at + len(x) + 1 < n]
            new[at + len(x) + 1] = True
        for a, b in spans:
            new[a + 1 : b] = False
        return np.flatnonzero(new)

    def words(self, text: pa.LargeStringArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """All words of the texts, and the place of each text's first word (and their number)."""
        text.validate(full=True)
        first, data = _parts(text)
        start = self.starts(data, first)
        return _binary(np.append(start, len(data)), data), np.searchsorted(start, first)


def _parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of an array of large strings or binaries without nulls."""
    if not len(array):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = array.buffers()
    first = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return first - first[0], data[first[0] : first[-1]]


def _binary(first: np.ndarray, data: np.ndarray) -> pa.LargeBinaryArray:
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(first.astype(np.int64, copy=False)), pa.py_buffer(data)])


def portions(text: pa.Array) -> Iterator[tuple[int, pa.LargeStringArray]]:
    """Texts (null: empty) by about PORTION bytes, each with the place of its first one."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    first, at = _parts(text)[0], 0
    while at < len(text):
        end = max(int(np.searchsorted(first, first[at] + PORTION, "right")) - 1, at + 1)
        yield at, text.slice(at, end - at)
        at = end


def compile_lexicon(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """The minimal acyclic transducer of the words: arcs sorted by (state, byte), targets, added numbers, finals, outputs."""
    register: dict[tuple, int] = {}
    arcs_of: list[tuple] = []  # per minimal state: (final, ((byte, target), ...))

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(arcs_of)
            arcs_of.append(key)
        return register[key]

    order = sorted(words)
    path: list[list] = [[False, []]]  # open nodes along the last word
    last = b""
    for word in [*order, None]:
        common = 0
        if word is not None:
            while common < min(len(last), len(word)) and last[common] == word[common]:
                common += 1
        while len(path) - 1 > common:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(node)))
        if word is None:
            break
        for _ in word[common:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    root = settle(path[0])
    count = [0] * len(arcs_of)
    for s, (final, arcs) in enumerate(arcs_of):  # targets have smaller numbers
        count[s] = final + sum(count[t] for _, t in arcs)
    key, target, add = [], [], []
    for s, (final, arcs) in enumerate(arcs_of):
        n = int(final)
        for byte, t in arcs:
            key.append(s << 8 | byte), target.append(t), add.append(n)
            n += count[t]
    ids = [words[w] for w in order]
    return {
        "key": np.array(key, np.int64), "target": np.array(target, np.int32), "add": np.array(add, np.int32), "final": np.array([f for f, _ in arcs_of], np.uint8),
        "root": np.array([root], np.int32), "first": np.cumsum([0, *map(len, ids)], dtype=np.int64), "ids": np.array([i for x in ids for i in x], np.uint32),
    }


class Lexicon:
    """A compiled transducer in a mapped file."""

    NAMES = (("key", np.int64), ("target", np.int32), ("add", np.int32), ("final", np.uint8), ("root", np.int32), ("first", np.int64), ("ids", np.uint32))

    @classmethod
    def save(cls, arrays: dict[str, np.ndarray], path: str) -> None:
        with open(path, "wb") as f:
            f.write(np.array([len(arrays[n]) for n, _ in cls.NAMES], np.int64).tobytes())
            for n, kind in cls.NAMES:
                data = arrays[n].astype(kind).tobytes()
                f.write(data + b"\0" * (-len(data) % 8))

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        sizes = data[: 8 * len(self.NAMES)].view(np.int64)
        at = 8 * len(self.NAMES)
        for (name, kind), n in zip(self.NAMES, sizes, strict=True):
            width = int(n) * np.dtype(kind).itemsize
            setattr(self, name, data[at : at + width].view(kind))
            at += width + -width % 8

        self.outputs = _binary(4 * self.first, np.frombuffer(self.ids, np.uint8))

    def places(self, text: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each word its place in ``outputs``, or -1 outside the lexicon; all words walk together."""
        n = len(size)
        if not n or not len(self.key):
            return np.full(n, -1)
        state, number = np.full(n, self.root[0], np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero(size > 0)
        state[size == 0] = -1
        step = 0
        while len(live):
            want = state[live] << 8 | text[first[live] + step]
            k = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[k] == want
            state[live[~ok]] = -1
            live, k = live[ok], k[ok]
            state[live] = self.target[k]
            number[live] += self.add[k]
            step += 1
            live = live[size[live] > step]
        return np.where((state >= 0) & (self.final[np.maximum(state, 0)] > 0), number, -1)

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """For each word its ids, packed as little-endian 32-bit integers, or None outside the lexicon."""
        first, text = _parts(pa.array(words, pa.large_binary()))
        return [self.outputs[k].as_py() if k >= 0 else None for k in self.places(text, first[:-1], np.diff(first)).tolist()]


class Encoder:
    """Encodes and decodes texts in a worker."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon):
        self.vocab, self.lexicon = vocab, lexicon

    def encode_all(self, text: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of each text, packed as little-endian 32-bit integers."""
        words, bounds = self.vocab.words(text)
        words = words.dictionary_encode()
        first, data = _parts(words.dictionary)
        place = self.lexicon.places(data, first[:-1], np.diff(first))
        other = np.flatnonzero(place < 0)
        place[other] = len(self.lexicon.outputs) + np.arange(len(other))
        blocks = [self.vocab.ids_of(words.dictionary.take(pa.array(other[k : k + BLOCK]))) for k in range(0, len(other), BLOCK)]
        outputs = pa.concat_arrays([self.lexicon.outputs, *blocks])
        at, packed = _parts(outputs.take(pa.array(place[words.indices.to_numpy()])))
        return _binary(at[bounds], packed)

    def decode_all(self, packed: pa.LargeBinaryArray) -> pa.LargeStringArray:
        """The texts of packed ids; bytes that are no UTF-8 become U+FFFD."""
        bounds, ids = _parts(packed)
        at, data = _parts(self.vocab.tokens.take(pa.array(ids.view("<u4"))))
        raw = _binary(at[bounds // 4], data)
        try:
            return raw.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.large_string())

    def encode(self, texts: list[str]) -> list[bytes]:
        return [i for _, part in portions(pa.array(texts, pa.large_string())) for i in self.encode_all(part).to_pylist()]

    def decode(self, packed: bytes) -> str:
        return self.decode_all(pa.array([packed], pa.large_binary()))[0].as_py()


def frequent(docs: DataFrame, path: str, limit: int = LEXICON) -> list[str]:
    """The words with the largest counts over all texts, ``limit`` at most (classes of about equal counts come whole).

    A task keeps a bounded table: when it is full, words seen least are
    dropped, so that counts of rare words may fall short (lossy counting).
    """

    def count(it):
        vocab, table, seen, floor = _vocabulary(path), pa.array([], pa.large_binary()), np.zeros(0, np.int64), 0
        for b in it:
            for _, part in portions(b.column(0)):
                found = vocab.words(part)[0].value_counts()
                word, n = found.field(0), found.field(1).to_numpy()
                place = pc.fill_null(pc.index_in(word, value_set=table), -1).to_numpy()
                old, new = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
                seen[place[old]] += n[old]
                table, seen = pa.concat_arrays([table, word.take(pa.array(new))]), np.append(seen, n[new])
                if len(seen) > TABLE:  # half the table stays at most
                    floor = max(floor + 1, int(np.partition(seen, -(TABLE // 2) - 1)[-(TABLE // 2) - 1]))
                    stay = np.flatnonzero(seen > floor)
                    table, seen = table.take(pa.array(stay)), seen[stay]
        got = np.flatnonzero(seen > max(floor, 1))
        yield pa.RecordBatch.from_arrays([table.take(pa.array(got)).cast(pa.string()), pa.array(seen[got])], ["word", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = runtime.stored(counted.withColumn("size", F.floor(F.log2("n") * 16).cast("int")))
    # how many words there are of each size class tells from which class on they fit; only those reach the driver
    room, least = limit, None
    for r in counted.groupBy("size").count().orderBy(F.desc("size")).collect():  # at most 16 x 64 classes
        room -= r["count"]
        if room < 0:
            break
        least = r["size"]
    if least is None:
        return []
    return [r["word"] for r in counted.where(F.col("size") >= least).orderBy(F.desc("n"), "word").select("word").collect()]


_VOCABS: dict[str, Vocabulary] = {}
_ENCODERS: dict[str, Encoder] = {}  # the last one


def _vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABS:
        _VOCABS[path] = Vocabulary(path)
    return _VOCABS[path]


def encoder(path: str, name: str) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(_vocabulary(path), Lexicon(SparkFiles.get(name)))
    return _ENCODERS[name]


def prepare(docs: DataFrame, path: str, limit: int = LEXICON) -> str:
    """Compile the transducer of the corpus's frequent words and send it to the executors; its file's name."""
    spark = docs.sparkSession
    runtime.ship(spark)
    vocab = _vocabulary(path)
    words = {w.encode(): vocab.ids(w.encode()) for w in frequent(docs, path, limit)}
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    at = os.path.join(runtime.scratch(), name)
    Lexicon.save(compile_lexicon(words), at)
    spark.sparkContext.addFile(at)
    return name


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", limit: int = LEXICON) -> DataFrame:
    """(id, ids: packed little-endian 32-bit, decoded text) for every row of docs; path: the tokenizer's file, on every machine."""
    name = prepare(docs, path, limit)
    return _map(docs, path, name, id_col, "ids binary, decoded string", lambda ids, decoded, text: (ids.cast(pa.binary()), decoded.cast(pa.string())))


def _map(docs: DataFrame, path: str, name: str, id_col: str, fields: str, form) -> DataFrame:
    """(id, fields) for every row; form(ids, decoded texts, texts: arrays) makes the fields' arrays."""
    names = [id_col, *(f.split()[0] for f in fields.split(", "))]

    def run(it):
        enc = encoder(path, name)
        for b in it:
            for at, text in portions(b.column(1)):
                ids = enc.encode_all(text)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(text)), *form(ids, enc.decode_all(ids), text)], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col("text").cast("string")).mapInArrow(run, f"{id_col} {kind}, {fields}")


def _tokens(ids: pa.LargeBinaryArray) -> pa.Array:
    return pa.array(np.diff(_parts(ids)[0]) // 4)


def _sha256(array: pa.Array) -> pa.Array:
    first, data = _parts(array)
    return pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.string())


def _digest(ids: pa.LargeBinaryArray, decoded: pa.LargeStringArray, text: pa.LargeStringArray):
    return _tokens(ids), _sha256(ids), _sha256(decoded)


def encode_digest(docs: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """n_tokens and the digests of ids and decoded text, without moving either out of the workers."""
    return _map(docs, path, prepare(docs, path), id_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digest)


def _checked(ids: pa.LargeBinaryArray, decoded: pa.LargeStringArray, text: pa.LargeStringArray):
    return _tokens(ids), ids.cast(pa.binary()), pc.equal(decoded, text)


def encode_checked(docs: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """n_tokens, ids and whether the decoded ids give the text back (exact)."""
    return _map(docs, path, prepare(docs, path), id_col, "n_tokens long, ids binary, exact boolean", _checked)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(runtime.read(spark, sf_dir, "documents"), default_path())
