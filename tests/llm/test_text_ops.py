"""Decontamination, substring dedup, BPE, SimHash: brute force and odd input."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import time

import duckdb
import numpy as np
import pytest
import xxhash

from shiftwell.llm import bpe, decontaminate, neardup, simhash, substring


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted(map(str, df.astype(object).values.tolist()))


@pytest.mark.parametrize(("query", "sql"), [(decontaminate.op3_decontamination, decontaminate.ORACLE_SQL), (substring.op5_substring_dedup, substring.ORACLE_SQL)])
def test_same_as_sql(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert canonical(query(spark, sf_dir).toPandas()) == canonical(con.sql(sql).df())


# -- decontamination


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain_hits(text, items):
    w, hit, found = plain_words(text), set(), set()
    for name, t in items:
        iw = plain_words(t)
        n = min(13, len(iw))
        win = {tuple(iw[i : i + n]) for i in range(max(len(iw) - n + 1, 0))} if n and name is not None else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in win:
                hit |= set(range(i, i + n))
                found.add(str(name))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest()


@pytest.mark.parametrize("bits", [decontaminate.FILTER_BITS, 6])
def test_decontamination_by_brute_force(spark, odd, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
    some = [r.text for r in odd.orderBy("doc_id").limit(12).collect() if r.text]
    items = [(1, some[1]), (2, "ta ri"), (3, None), (4, "Same LINE here"), (5, ""), (None, some[2]), (6, " ".join(some[3].split()[2:20]) + " other words"), (10, "x " * 40), (1, some[1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.digest(decontaminate.hits(odd, bench)).collect()
    assert len(out) == odd.count()
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in out:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == plain_hits(texts[r.doc_id], items)
    assert decontaminate.hits(odd, bench.limit(0)).where("size(items) > 0").count() == 0
    assert decontaminate.hits(odd.limit(0), bench).count() == 0


def test_decontamination_of_repeated_words(spark):
    """A run of one word against a longer run: the work grows with the words, not with the pairs of places."""
    start = time.time()
    docs = spark.createDataFrame([(1, "x " * 30000), (2, "x " * 12 + "y"), (3, "y " + "x " * 14 + "z")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "x " * 10000), (2, "x " * 9999 + "y")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.digest(decontaminate.hits(docs, bench)).collect()}
    assert got == {1: (30000, 2), 2: (13, 1), 3: (14, 2)} and time.time() - start < 30
    w = decontaminate.tn.Words(np.frombuffer(b"x " * 30000, np.uint8), np.array([0, 60000]), decontaminate.tn.ALNUM)
    start = time.time()
    assert len(np.unique(decontaminate.windows(w, 13)[1])) == 1 and time.time() - start < 1


def test_decontaminated_rows(spark, odd):
    """clean keeps the rows that digest doesn't call contaminated, whichever way the keys go."""
    bench = spark.createDataFrame([(1, odd.where("doc_id = 3").first().text), (2, "same line here")], "item_id long, text string")
    bad = {r.doc_id for r in decontaminate.digest(decontaminate.hits(odd, bench)).where("contaminated").collect()}
    for most in (500_000, 0):
        decontaminate.runtime.SMALL_KEYS = most
        got = decontaminate.clean(odd, bench)
        assert got.columns == odd.columns and sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(str(r.doc_id) for r in odd.collect() if r.doc_id not in bad)
    decontaminate.runtime.SMALL_KEYS = 500_000


# -- substring dedup


def plain_dedup(rows):
    seen, out = {}, {}
    for k, t in sorted(rows.items()):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone |= set(range(i, i + 20))
            else:
                seen[key] = (k, i)
        out[k] = [x for i, x in enumerate(w) if i not in gone]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_substrings_by_brute_force(spark, odd, monkeypatch, small):
    if small:
        for k, v in (("FLUSH", 500), ("BUCKET_BYTES", 20000), ("SHARD_BYTES", 5000), ("SALT_AT", 1), ("HOT_WINDOWS", 1), ("HOT_SHARE", 1)):
            monkeypatch.setattr(substring, k, v)
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(120)) for _ in range(6)]
    rows = {r.doc_id: r.text for r in odd.where("doc_id is not null").collect()}
    for i in range(40):
        a, b = rng.choice(base).split(), rng.choice(base).split()
        cut = rng.randrange(100)
        rows[100 + i] = " ".join(a[cut : cut + rng.randrange(15, 60)] + b[rng.randrange(50) :])
    df = spark.createDataFrame([(k, t, 1) for k, t in rows.items()], "doc_id long, text string, doc int").repartition(5)
    form = lambda words, kept: (len(words), b" ".join(kept).decode())
    got = {r.doc: (r.n, r.t) for r in substring.apply(df, form, "n long, t string").collect()}
    want = plain_dedup(rows)
    assert {k: v[1] for k, v in got.items()} == {k: " ".join(v) for k, v in want.items()}


def test_two_texts_of_one_id(spark):
    """Each text of an id is a document of its own: only what is repeated goes."""
    words = lambda a, n: " ".join(f"w{a}x{i}" for i in range(n))
    alone, one, two = words(1, 75), words(2, 60), words(3, 25)
    rows = [(1, one), (7, alone), (7, one + " " + two), (7, alone), (9, two), (None, one), (5, None), (5, "")]
    got = sorted(((r.doc_id, r.text) for r in substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, one), (7, alone), (7, two), (7, alone), (9, ""), (None, one), (5, None), (5, "")], key=str)
    # equal passages of two texts of one id: one of them keeps it
    both = [(3, one + " " + alone), (3, one + " " + two)]
    left = sorted(len(r.text.split()) for r in substring.deduplicate(spark.createDataFrame(both, "doc_id long, text string")).collect())
    assert left in ([25, 135], [75, 85])


def test_phrase_in_every_document(spark, monkeypatch):
    """Windows of a frequent anchor are dealt over all buckets, and copies among them are found as before."""
    monkeypatch.setattr(substring, "HOT_SHARE", 1)
    rng = random.Random(6)
    phrase = " ".join(f"common{k}" for k in range(12))
    text = [" ".join([*(f"a{i}x{rng.randrange(10**6)}" for _ in range(14)), phrase, *(f"b{i}x{rng.randrange(10**6)}" for _ in range(14))]) for i in range(1500)]
    rows = dict(enumerate(text + text[:3]))
    own = substring._own(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(6), "doc_id")
    most = {}
    for least in (10**9, 500):
        monkeypatch.setattr(substring, "HOT_WINDOWS", least)
        marks = substring._frequent(own)
        assert marks.any() == (least == 500)
        hot = spark.sparkContext.broadcast(marks)
        sizes = own.mapInArrow(substring._nominate(16, hot), substring.NOMINATED).where("blob is not null").selectExpr("bucket", "length(blob) as n").groupBy("bucket").sum("n").collect()
        most[least] = max(r[1] for r in sizes) / sum(r[1] for r in sizes)
    assert most[500] < most[10**9] / 2
    got = {r.doc: r.n for r in substring.apply(own.select(own.doc.alias("doc_id"), "text"), lambda words, kept: (len(kept),), "n long").collect()}
    assert got == {k: len(v) for k, v in plain_dedup(rows).items()}


def test_substring_odd_rows(spark, odd):
    out = substring.deduplicate(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append(r.text)
    assert len(set(by[2])) == 1 and len(by[2]) == 3 and by[None] == [odd.where("doc_id is null").first().text]
    assert substring.deduplicate(odd.limit(0)).count() == 0


def test_automaton():
    rng = random.Random(2)
    refs = ["".join(rng.choice("ab") for _ in range(40)) for _ in range(3)]
    sam = substring.SuffixAutomaton()
    for r in refs:
        sam.add(r)
    for _ in range(50):
        t = "".join(rng.choice("ab") for _ in range(60))
        want = set()
        for i in range(len(t) - 6):
            if any(t[i : i + 7] in r for r in refs):
                want |= set(range(i, i + 7))
        assert {i for a, b in sam.matches(t, 7) for i in range(a, b)} == want


# -- BPE


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_path())


def test_bpe_equals_library(spark, docs, odd, tokenizer):
    for df in (docs.select("doc_id", "text"), odd):
        got = bpe.encode(df, bpe.default_path(), limit=500).collect()
        text = {r.doc_id: r.text or "" for r in df.collect()}
        assert len(got) == df.count()
        for r in got:
            ids = tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids
            assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
            assert r.decoded == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.encode_digest(odd.limit(0), bpe.default_path()).count() == 0


def test_bpe_hard_texts(tokenizer, tmp_path):
    v = bpe.Vocabulary(bpe.default_path())
    bpe.Lexicon.save(bpe.compile_lexicon({w: v.merge(w) for w in (b" the", b"the", b" they", b"a", b" other")}), str(tmp_path / "l"))
    lex = bpe.Lexicon(str(tmp_path / "l"))
    assert lex.find([b"th", b"they", b"", b" they"])[:3] == [None] * 3 and lex.find([b" they"])[0] is not None
    e = bpe.Encoder(v, lex)
    rng = random.Random(4)
    hard = ["<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "don't I'LL 'sS", "ab" * 5000, " " * 700, "\r\n\x85\u2003x\u200b  ", "\u0558a \U0003d44c's", "ꟑ漢字٠½"]
    hard += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0xD800), rng.randrange(0x10000, 0x1F000), 32, 10])) for _ in range(12)) for _ in range(800)]
    for t, ids in zip(hard, e.encode(hard), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
        assert e.decode(ids) == t


def test_bpe_cuts_as_the_library(tokenizer, tmp_path, monkeypatch):
    """Random mixtures of blanks, apostrophes, special tokens and all sorts of characters, in portions of any size."""
    v = bpe.Vocabulary(bpe.default_path())
    rng = random.Random(7)
    bits = [" ", " ", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "'", "'", "'s", "'ll", "'re", "'d", "l", "v", "e", "S", "é", "ſ", "7", "²", "٠", "!", "’", "漢", "\U0001f600", "\u0301", "<|endoftext|>", "<|endof", "text|>", "<|endoftext|"]
    hard = ["".join(rng.choices(bits, k=rng.randrange(14))) for _ in range(6000)] + ["<|endof", "text|>", "", "'", "s", " ", "'l", "l", "\u3000"]
    hard += [f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}{chr(c)}'s" for c in rng.sample([*range(0xD800), *range(0xE000, 0x110000)], 3000)]
    hard += ["".join(rng.choices("qxzjé ", k=300)) for _ in range(20)] + ["x" * 255, "é" * 128, "x" * 256 + "y", "<|endoftext|>" * 3]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in hard]
    for known in ({}, {w: v.ids(w) for w in (b" ", b"'s", b"!", b"<|endoftext|>")}):
        bpe.Lexicon.save(bpe.compile_lexicon(known), str(tmp_path / f"l{len(known)}"))
        e = bpe.Encoder(v, bpe.Lexicon(str(tmp_path / f"l{len(known)}")))
        for size in (1, 700, 4 << 20):
            monkeypatch.setattr(bpe, "PORTION", size)
            got = e.encode(hard)
            assert [np.frombuffer(i, "<u4").tolist() for i in got] == want
            assert [e.decode(i) for i in got] == hard
    for ids in ([v.single[0xE6], v.single[0xBC]], [v.single[0xFF], v.single[0x41]], []):
        assert e.decode(np.array(ids, "<u4").tobytes()) == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_works_in_bulk(tmp_path):
    """No calls for each word, known or not."""
    v = bpe.Vocabulary(bpe.default_path())
    bpe.Lexicon.save(bpe.compile_lexicon({b" the": v.merge(b" the")}), str(tmp_path / "l"))
    e = bpe.Encoder(v, bpe.Lexicon(str(tmp_path / "l")))
    rng = random.Random(3)
    texts = [" ".join("the" if rng.random() < 0.5 else "".join(rng.choices("abcdefgh", k=7)) for _ in range(100)) for _ in range(200)]
    calls = [0]
    sys.setprofile(lambda frame, event, arg: calls.__setitem__(0, calls[0] + (event in ("call", "c_call"))))
    try:
        ids = e.encode(texts)
    finally:
        sys.setprofile(None)
    assert [e.decode(i) for i in ids] == texts
    assert calls[0] < 200 * 100 / 4


# -- SimHash


def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    parent = {k: k for k in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(prints)
    for i, a in enumerate(names):
        for b in names[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in prints}


def test_simhash_by_brute_force(docs, odd):
    for df in (docs, odd.where("doc_id is not null")):
        prints = {r.doc_id: plain_print(r.text) for r in df.collect()}
        want = plain_components(prints)
        got = neardup.near_duplicates(df).collect()
        assert len(got) == df.count()
        for r in got:
            assert r.fp % (1 << 64) == prints[r.doc_id] and r.component_id == want[r.doc_id]
    assert neardup.near_duplicates(odd).count() == odd.count() and neardup.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [512, 3])
def test_links_lose_nothing(spark, monkeypatch, hot):
    monkeypatch.setattr(neardup, "HOT", hot)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(hot)
    fps = {0}
    for _ in range(12):
        c = rng.getrandbits(64)
        fps |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(25)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = neardup.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    roots = {r.node: r.root for r in neardup.components(edges).collect()}
    want = plain_components({x: x % (1 << 64) for x in signed})
    for x in signed:
        for y in signed:
            assert (want[x] == want[y]) == (roots.get(x, x) == roots.get(y, y))


def test_allocation():
    cost, t = simhash.allocate([[0, 1, 10, 100, 1000], [0, 5, 6, 7, 1000]], 4)
    assert sum(x + 1 for x in t) == 4 and cost == 1 + 7
    corr = np.eye(64)
    corr[0, 63] = corr[63, 0] = 0.9
    groups = simhash.group_bits(corr, 3)
    assert sorted(b for g in groups for b in g) == list(range(64)) and any({0, 63} <= set(g) for g in groups)


def test_star_of_many(spark, monkeypatch):
    """Hubs: a star's rows are joined where they are, and components stay right."""
    monkeypatch.setattr(neardup, "HUB", 50)
    n = 100_000
    edges = spark.range(1, n + 1).selectExpr("id + 10 as u", "5L as v").union(spark.createDataFrame([(7, 3), (3, 5), (2, 1)], "u long, v long"))
    got = neardup.components(edges).groupBy("root").count().collect()
    assert {r.root: r["count"] for r in got} == {3: n + 2, 1: 1} or {r.root: r["count"] for r in got} == {3: n + 3, 1: 2}
