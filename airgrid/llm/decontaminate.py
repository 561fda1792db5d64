"""Benchmark decontamination over training suffix arrays.

Training texts are dealt out as Spark deals them; each task cuts its rows into
shards and builds a suffix array over the words of each shard.  Every suffix of
every test text is binary-searched in the array of each shard, which gives its
longest verbatim match and all places of it.  No training text is shuffled.

The test texts are the stated query set.  They come to the driver once, one partition at a
time, and leave it as broadcast blocks whose bytes are bounded (``BLOCK_BYTES``).  A task
holds the arrays of at most ``GROUP_SHARDS`` shards and one block at a time, so a large
benchmark costs time and not memory.

Defined cases: null and wordless texts have no words and no hits; a test text of
fewer words than ``window`` is one window of all its words; repeated rows give
repeated results; repeated item ids count once; of equally long matches of an item
the first place is told; a very long text is a shard of its own; a null item id marks
words but is not listed; columns of any name are kept as they are; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import fresh, named

WINDOW = 10
#: Bytes of test texts in one broadcast block.
BLOCK_BYTES = 16 << 20
#: Bytes of training text in one suffix array.
SHARD_BYTES = 1 << 20
#: Shards that a task searches with one block after the other.
GROUP_SHARDS = 8

MATCH = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("matches", T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("doc_word", T.LongType()), T.StructField("item_word", T.LongType()), T.StructField("length", T.LongType())]))),
    ]
)
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("length", pa.int64())]))),
    ]
)


class TestBlock:
    """The words of some test texts, and the suffixes that start a window."""

    __test__ = False

    def __init__(self, ids: list, texts: list, window: int):
        col = pa.array([t or "" for t in texts], pa.string())
        data, off = W.column_bytes(col)
        s, e, bounds = W.word_spans(data, off, W.ALNUM)
        self.ids = ids
        h = W.word_hashes(data, s, e)
        n = np.diff(bounds)
        self.longest = int(n.max(initial=0))
        # each text is followed by words that match nothing
        self.word = np.concatenate([h, np.zeros(1, np.uint64)])
        count = np.where(n == 0, 0, np.maximum(n - window + 1, 1))
        first = np.concatenate([[0], np.cumsum(count)])
        self.item = np.repeat(np.arange(len(ids)), count)
        self.start = np.arange(first[-1]) + np.repeat(bounds[:-1] - first[:-1], count)
        self.end = np.repeat(bounds[1:], count)
        self.begin = np.repeat(bounds[:-1], count)
        self.need = np.minimum(window, self.end - self.start)


def suffix_array(w: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``w`` (32-bit words) in the order of their first ``depth`` words, and their first two words as keys.

    Sorts by two words, then doubles the depth for suffixes that are still equal.
    """
    n = len(w)
    nxt = np.zeros(n, np.uint64)
    nxt[:-1] = w[1:]
    key = (w.astype(np.uint64) << np.uint64(32)) | nxt
    sa = np.argsort(key)
    keys = key[sa]
    new = np.ones(n, bool)
    new[1:] = keys[1:] != keys[:-1]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = group
    k = 2
    while k < depth:
        last = np.ones(n, bool)
        last[:-1] = new[1:]
        slots = np.flatnonzero(~(new & last))
        if not len(slots):
            break
        at = sa[slots]
        sub = rank[at] * (n + 2) + rank[np.minimum(at + k, n)] + 1
        order = np.argsort(sub)
        at, sub = at[order], sub[order]
        sa[slots] = at
        fresh_group = np.ones(len(slots), bool)
        fresh_group[1:] = sub[1:] != sub[:-1]
        new[slots] = fresh_group
        rank[at] = np.maximum.accumulate(np.where(fresh_group, slots, 0))
        k *= 2
    return sa, keys


def _bound(w: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: int, want: np.ndarray, right: bool) -> np.ndarray:
    """Binary search for ``want`` as the word at depth ``d`` in each range of the array."""
    lo, hi, n = lo.copy(), hi.copy(), len(w)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        p = sa[np.minimum(mid, len(sa) - 1)] + d
        got = np.where(p < n, w[np.minimum(p, n - 1)], 0)
        go = open_ & ((got <= want) if right else (got < want))
        lo = np.where(go, mid + 1, lo)
        hi = np.where(open_ & ~go, mid, hi)


def search_shard(w64: np.ndarray, sa: np.ndarray, keys: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All places of all windows: their test suffix, their word in the shard, and the words that match from there on."""
    none = np.zeros(0, np.int64)
    if not len(w64) or not len(block.start):
        return none, none, none
    w, test = (w64 >> np.uint64(32)).astype(np.uint32), (block.word >> np.uint64(32)).astype(np.uint32)
    one = block.need == 1
    first = test[block.start].astype(np.uint64) << np.uint64(32)
    second = np.where(one, 0, test[np.minimum(block.start + 1, len(test) - 1)]).astype(np.uint64)
    top = np.where(one, np.uint64(0xFFFFFFFF), second)
    lo = np.searchsorted(keys, first | second, "left")
    hi = np.searchsorted(keys, first | top, "right")
    live = np.flatnonzero(lo < hi)
    for d in range(2, int(block.need.max())):
        go = live[block.need[live] > d]
        if not len(go):
            break
        want = test[block.start[go] + d]
        a = _bound(w, sa, lo[go], hi[go], d, want, False)
        hi[go] = _bound(w, sa, a, hi[go], d, want, True)
        lo[go] = a
        live = live[lo[live] < hi[live]]
    count = hi[live] - lo[live]
    suffix = np.repeat(live, count)
    place = sa[np.arange(count.sum()) + np.repeat(lo[live] - (np.cumsum(count) - count), count)]
    # longest match from each place, now with all 64 bits of each word
    length = np.zeros(len(place), np.int64)
    left = np.arange(len(place))
    d = 0
    while len(left):
        p, t = place[left] + d, block.start[suffix[left]] + d
        same = (p < len(w64)) & (t < block.end[suffix[left]])
        same &= w64[np.minimum(p, len(w64) - 1)] == block.word[np.minimum(t, len(block.word) - 1)]
        left = left[same]
        length[left] += 1
        d += 1
    real = length >= block.need[suffix]
    return suffix[real], place[real], length[real]


class Shard:
    """Some rows of a batch, the suffix array over their words, and what has been found in them."""

    def __init__(self, part: pa.RecordBatch, text_at: int, window: int):
        self.part = part
        data, off = W.column_bytes(part.column(text_at))
        s, e, bounds = W.word_spans(data, off, W.ALNUM)
        self.n = n = np.diff(bounds)
        # a word of its own after each text, so that no match runs on into the next
        self.h = np.zeros(len(s) + len(n), np.uint64)
        self.at = bounds[:-1] + np.arange(len(n))
        self.h[np.arange(len(s)) + np.repeat(np.arange(len(n)), n)] = W.word_hashes(data, s, e)
        self.h[bounds[1:] + np.arange(len(n))] = W.mix(np.arange(1, len(n) + 1, dtype=np.uint64))
        self.sa, self.keys = suffix_array((self.h >> np.uint64(32)).astype(np.uint32), max(2, window))
        self.delta = np.zeros(len(self.h) + 1, np.int64)
        self.matches: list[list] = [[] for _ in n]

    def search(self, block: TestBlock) -> None:
        suffix, place, length = search_shard(self.h, self.sa, self.keys, block)
        if not len(place):
            return
        np.add.at(self.delta, place, 1)
        np.add.at(self.delta, place + block.need[suffix], -1)
        row = np.searchsorted(self.at, place, "right") - 1
        # of the places of one item in a text, the longest
        item = block.item[suffix]
        order = np.lexsort((place, -length, item, row))
        row, item, place, length, suffix = (x[order] for x in (row, item, place, length, suffix))
        keep = np.ones(len(row), bool)
        keep[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
        word = block.start[suffix] - block.begin[suffix]
        for r, i, p, q, k in zip(*(x[keep].tolist() for x in (row, item, place - self.at[row], word, length)), strict=True):
            self.matches[r].append({"item_id": block.ids[i], "doc_word": p, "item_word": q, "length": k})

    def result(self) -> pa.Array:
        hit = np.concatenate([[False], np.cumsum(self.delta)[:-1] > 0, [False]])
        a, b = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(~hit[1:] & hit[:-1])
        row = np.searchsorted(self.at, a, "right") - 1
        spans: list[list] = [[] for _ in self.n]
        for r, x, y in zip(row.tolist(), (a - self.at[row]).tolist(), (b - self.at[row]).tolist(), strict=True):
            spans[r].append({"start": x, "end": y})
        return pa.array([{"n_words": int(k), "spans": x, "matches": m} for k, x, m in zip(self.n, spans, self.matches, strict=True)], _ARROW)


def test_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list, list]]:
    """The test texts in blocks of at most ``block_bytes`` each (a longer text is a block by itself)."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null").orderBy("i", "t")
    ids, texts, n = [], [], 0
    for r in rows.toLocalIterator():
        size = len(r.t.encode())
        if texts and n + size > block_bytes:
            yield ids, texts
            ids, texts, n = [], [], 0
        ids.append(r.i)
        texts.append(r.t)
        n += size
    yield ids, texts


test_blocks.__test__ = False


def _groups(batches: Iterator[pa.RecordBatch], text_col: str, window: int, size: int) -> Iterator[list[Shard]]:
    """Shards, ``size`` of them at a time."""
    group: list[Shard] = []
    for batch in batches:
        at = batch.schema.names.index(text_col)
        for a, b in W.row_slices(batch.column(at), SHARD_BYTES):
            group.append(Shard(batch.slice(a, b - a), at, window))
            if len(group) == size:
                yield group
                group = []
    if group:
        yield group


def find_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id", bench_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, column: str = "contamination") -> tuple[DataFrame, str]:
    """``docs`` with a struct column more (named ``column``, or so that it clashes with none).

    It has n_words, the word spans that lie in an occurrence of a window, and for
    each test item found its longest verbatim match: item id, word in the text, word in
    the item and length in words.
    """
    name = fresh(docs.columns, column)
    sent = [docs.sparkSession.sparkContext.broadcast(x) for x in test_blocks(benchmark, id_col, bench_text, block_bytes)]
    # any signs may be in the columns' names, but not in those that go through Arrow
    plain = docs.toDF(*(f"_c{i}" for i in range(len(docs.columns))))
    text_at = plain.columns[docs.columns.index(text_col)]
    schema = T.StructType([*plain.schema.fields, T.StructField("_found", MATCH)])

    def work(batches):
        only = TestBlock(*sent[0].value, window) if len(sent) == 1 else None
        for group in _groups(batches, text_at, window, 1 if only else GROUP_SHARDS):
            for one in sent:
                block = only or TestBlock(*one.value, window)
                for shard in group:
                    shard.search(block)
                del block
                vars(one).pop("_value", None)  # read again from the worker's disk when it is needed again
            for shard in group:
                yield pa.RecordBatch.from_arrays([*shard.part.columns, shard.result()], names=schema.names)

    return plain.mapInArrow(work, schema).toDF(*docs.columns, name), name


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without those that hold a window of a test text; their columns as they were."""
    found, name = find_matches(docs, benchmark, **options)
    return found.where(F.size(F.col(name)["spans"]) == 0).select(*named(docs.columns))


def digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match."""
    found, name = find_matches(docs.select("doc_id", "text"), benchmark, **options)
    c = F.col(name)
    ids = F.array_sort(F.array_distinct(F.filter(F.transform(c["matches"], lambda m: m["item_id"]), lambda x: x.isNotNull())))
    hit = F.aggregate(c["spans"], F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform(c["matches"], lambda m: m["length"])), F.lit(0).cast("long")).alias("longest_match"),
    )
