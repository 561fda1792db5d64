"""Importance resampling, ranked search and byte-level encoding against brute force, and their defined cases."""

import base64
import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from airgrid.llm import bpe, common, registry, resample, search
from airgrid.llm import words as W

LONG = "word%d x " * 3
ODD = [
    (1, "the cat sat on the mat and the cat ran", "a"), (1, "the cat sat on the mat and the cat ran", "a"), (2, None, "b"), (None, "a null id has a cat", "b"), (None, None, None),
    (3, "", "c"), (4, " \n\t…", "c"), (5, "Ünï Ünï É x", "c"), (6, "cat " * 30_000, "d"), (7, "x" * 300 + " cat " + "x" * 300 + " " + "y" * 255 + " x", "d"), (8, "<|endoftext|> it's   we'LL\r\n don't  ", "e"),
    (9, " ".join(f"W{i % 50} cat" for i in range(40)), "e"), (10, "MAT mat mat", "f"), (11, "\x00a\x7fb`c_d[e", "f"),
]
BENCH = [(1, "the cat and the MAT"), (1, "sat on"), (2, None), (3, ""), (None, "x cat"), (4, "Ünï nowhere"), (5, "the cat and the MAT")]


@pytest.fixture(scope="module")
def tables(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    for c in ("n", "term", "tf", "row", "k", "ids", "bytes", "buckets", "counts", "rank", "row.key", "score", "slot", "_run", "item"):
        docs = docs.withColumn(c, F.lit(c))
    bench = spark.createDataFrame(BENCH, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("score", F.lit(1))
    return docs, bench


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(docs, bench, percent=5):
    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    s, t = (collections.Counter(bucket(g) for r in rows for g in grams(r[1])) for rows in (docs, bench))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    out = []
    for doc_id, text, *_ in docs:
        weight = sum(gain(bucket(g)) for g in grams(text))
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(words(text)), len(grams(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is not None, x[0] or 0))
    drawn = collections.Counter(x[:5] for x in able[: percent * len(able) // 100])
    return collections.Counter(out), drawn


def test_resample_odd(tables):
    docs, bench = tables
    for percent in (5, 60):
        got = resample.resampled(docs, bench, percent=percent).collect()
        every, drawn = plain_resample(ODD, BENCH, percent)
        assert collections.Counter(tuple(r[:5]) for r in got) == every
        assert collections.Counter(tuple(r[:5]) for r in got if r["rank"] is not None) == drawn
        assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, drawn.total() + 1))


def test_resample_slices_and_repeats(spark, monkeypatch):
    """Texts cut into many small slices give what one slice gives; equal scores are drawn in order of doc_id, repeated rows each by itself."""
    monkeypatch.setattr(resample, "SLICE_BYTES", 100)
    rows = [(i % 40, " ".join(f"w{(i * j) % 23}" for j in range(i % 40 + 5))) for i in range(120)]
    bench = [(1, "w1 w2 w3 w4")]
    got = resample.resampled(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame(bench, "item_id long, text string"), percent=50).collect()
    every, drawn = plain_resample(rows, bench, 50)
    assert collections.Counter(tuple(r[:5]) for r in got) == every and collections.Counter(tuple(r[:5]) for r in got if r["rank"]) == drawn
    order = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert order == sorted(order, key=lambda r: (-r.score, r.doc_id))


def test_joined_checksums():
    rng = np.random.default_rng(1)
    parts = [(rng.bytes(int(a)), rng.bytes(int(b))) for a, b in rng.integers(0, resample.TABLED + 2, (200, 2))]
    crc = lambda i: np.array([zlib.crc32(p[i]) for p in parts], np.uint32)
    got = resample.joined_crc(crc(0), crc(1), np.array([len(p[1]) for p in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_runs_hash_each_n_gram_once(monkeypatch):
    """As many checksums as there are different n-grams, however often they occur."""
    seen = []
    plain = resample.Slice._crc
    monkeypatch.setattr(resample.Slice, "_crc", lambda self, w, at, n: seen.append((n, len(at))) or plain(self, w, at, n))
    texts = ["a b c a b c a b c d", "a b c", "", "c d"]
    resample.Slice([t.encode() for t in texts])
    assert seen == [(n, len({" ".join(t.split()[i : i + n]) for t in texts for i in range(len(t.split()) - n + 1)})) for n in (1, 2, 3)]


def plain_search(docs, bench, best):
    texts = [(d, collections.Counter(words(t))) for d, t, *_ in docs]
    texts = [(d, c) for d, c in texts if c]
    n_docs, total = len(texts), sum(c.total() for _, c in texts)
    df = collections.Counter(t for _, c in texts for t in c)
    items = collections.defaultdict(set)
    for i, t in bench:
        if t is not None:
            items[i] |= set(words(t))
    out = []
    for item, terms in items.items():
        scores = []
        for d, c in texts:
            m = 50 + 50 * c.total() * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((d, score))
        scores.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out += [(item, i + 1, d, s) for i, (d, s) in enumerate(scores[:best])]
    return sorted(out, key=str)


@pytest.mark.parametrize("best", [1, 2, 50])
@pytest.mark.parametrize("block", [1, 1 << 20])
def test_search_odd(tables, best, block):
    """Blocks of one item each give what one block gives; ties, repeated rows and items of several rows are ranked as told."""
    docs, bench = tables
    got = search.search(docs, bench, best=best, block_bytes=block)
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(ODD, BENCH, best)


def test_search_prunes_and_keeps_all_ties(spark, monkeypatch):
    """Random texts with many copies, in small slices: the same as scoring everything, with fewer pairs than all."""
    rng = np.random.default_rng(7)
    share = 1 / np.arange(1, 301)
    draw = lambda n: " ".join(f"t{x}" for x in rng.choice(300, n, p=share / share.sum()))
    texts = [draw(int(n)) for n in rng.integers(3, 60, 600)]
    rows = [(i, texts[0] if i % 3 == 0 else t) for i, t in enumerate(texts)]
    bench = [(i, draw(12)) for i in range(20)]
    monkeypatch.setattr(search, "POSTINGS", 400)
    docs, items = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(bench, "item_id long, text string")
    got = sorted(map(tuple, search.search(docs, items, best=10).collect()), key=str)
    assert got == plain_search(rows, bench, 10)
    block = next(search.item_blocks(items, 1 << 20))
    found = search.hits(docs, block)
    size = tuple(found.agg({"n": "count"}).first()) + tuple(found.agg({"n": "sum"}).first())
    bounds = search.Bounds(block, search.term_impacts(found, size, 10).toArrow(), 10)
    kth = {i: [s for item, rank, _, s in got if item == i and rank == 10] for i in range(20)}
    assert all(bounds.seed[i] <= kth[i][0] for i in range(20) if kth[i])
    bounds.split(bounds.seed)
    assert bounds.rest.sum() > 0 and (bounds.slack < np.maximum(bounds.seed, 1)).all()


def test_search_and_resample_of_nothing(tables):
    docs, bench = tables
    assert search.search(docs.limit(0), bench).count() == search.search(docs, bench.limit(0)).count() == 0
    assert resample.resampled(docs.limit(0), bench).count() == 0
    assert resample.resampled(docs, bench.limit(0)).count() == len(ODD)
    assert bpe.digest(docs.limit(0)).count() == 0


def reference(text):
    ids = bpe.encoder(bpe.vocabulary()).encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk", [12, 40, 1000, bpe.CHUNK])
def test_encoding_by_chunks(spark, tables, chunk):
    """However small the chunks, the ids are those of the whole text, and decode to its bytes."""
    docs, _ = tables
    rng = np.random.default_rng(2)
    odd = ["a", "é", "²", "٣", "  ", "\n\n ", "'ll", "'s", "!", "…", "࢏", "\U0001e030", "😀", " the", "x" * 30, "　", "don't", "\x85", "漢字" * 9]
    rows = [(100 + i, "".join(rng.choice(odd, 60))) for i in range(60)]
    every = [(a, b) for a, b, _ in ODD] + rows
    both = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = bpe.digest(both, chunk=chunk, overlap=min(chunk, 40)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter((d, *reference(t)) for d, t in every)


def test_pieces_are_stitched_not_whole(spark):
    """Text of ordinary words is cut at every chunk; after a word longer than the overlap the rest is one piece."""
    text = " ".join(f"word{i}" for i in range(500))
    rows = [(1, text), (2, text + "z" * 300 + " " + text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id as row", "*")
    ready = common.stored(bpe.pretokenised(bpe.cut_texts(docs, "row", 100, 50), 100, 50), "test-pretokens")
    pieces = collections.defaultdict(list)
    for r in sorted(bpe.stitched(ready, 100).collect()):
        pieces[r.doc_id].append(r.text)
    assert {d: "".join(p) for d, p in pieces.items()} == dict(rows)
    assert len(pieces[1]) == math.ceil(len(text) / 100) and max(map(len, pieces[1])) <= 150
    assert len(text) // 100 - 1 <= len(pieces[2]) <= len(text) // 100 + 3


def test_classes_are_those_of_the_encoder():
    """Each character of every plane is told apart as the encoding library does it."""
    import regex

    classes = bpe.Classes()
    letter, digit, blank = (regex.compile(p) for p in (r"\p{L}", r"\p{N}", r"\s"))
    for code in [*range(0x3000), *range(0x3000, 0x110000, 37)]:
        if not 0xD800 <= code < 0xE000:
            c = classes[code]
            want = [bool(e.encode_ordinary(chr(code))) for e, _ in classes.of]
            assert [bool(p.match(c)) for p in (letter, digit, blank)] == want, hex(code)


def test_decoding_joins_raw_bytes(spark):
    ids = bpe.encoder(bpe.vocabulary()).encode_ordinary("é漢😀")
    cut = [(1, ids[:1]), (2, ids), (3, []), (4, None)]
    got = {r.doc_id: r.bytes and bytes(r.bytes) for r in bpe.decode(spark.createDataFrame(cut[:3], "doc_id long, ids array<int>")).collect()}
    ranks = {int(i): base64.b64decode(t) for t, i in map(bytes.split, open(bpe.vocabulary(), "rb"))}
    assert got[1] == ranks[ids[0]] and got[2].decode() == "é漢😀" and not got[3]


@pytest.mark.parametrize("name", ["op11_resample", "op12_search"])
def test_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = registry.queries()[name](spark, sf).toPandas()
    want = db.sql(registry.oracle_sql()[name]).df()[list(got.columns)]
    plain = lambda df: sorted(map(tuple, df.astype(float).fillna(-1).values.tolist()))
    assert plain(got) == plain(want)


def test_op13_on_the_smallest_tables(spark, sf):
    got = registry.queries()["op13_bpe"](spark, sf).collect()
    assert {tuple(r) for r in got} == {(r.doc_id, *reference(r.text)) for r in common.table(spark, sf, "documents").collect()}


def test_folded_words_are_the_pattern():
    for _, text, _ in ODD:
        assert [w.decode() for w in W.folded_words((text or "").encode())] == words(text)
