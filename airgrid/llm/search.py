"""Ranked lexical search by a threshold-seeded join.

Items are taken in blocks of bounded size.  For a block, each task reduces its documents to the
terms that the block's items hold, with their counts (``hits``, stored).  From those come, for each
term, its document frequency, its largest impact and its kth largest one (stored).  The kth impact
of any term of an item is a lower bound of the item's kth score, as impacts are never negative.

The join then goes term by term from documents to items.  An item's terms are ordered by largest
impact; a run of the weakest whose largest impacts sum to less than the threshold cannot lift a
document into the result, so only the postings of the other terms generate candidates.  A candidate
whose sum so far and that bound together stay under the threshold is dropped too; all others are
scored exactly, over all terms of the item.  Each task goes on with the larger of the seed and the
kth score that it has found itself, which is a lower bound as well.  Only the k best of each item
leave a task.  Bounds are compared strictly, so ties are never pruned.

What a task holds is bounded by a block and a slice of documents; more items make more blocks.

Defined cases: null, empty and wordless texts have no terms and are not counted; a very long text
is a row like others; repeated documents are ranked each by itself; equal scores go by doc_id, null
ids last; rows with one item id are one item with the terms of all of them, a null id among them;
an item longer than a block is a block by itself; other columns are not read; empty tables give no
rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import stored

BEST = 50
#: Bytes of item texts in one block.
BLOCK_BYTES = 4 << 20
#: Parts into which an item's best rows of all tasks are cut before they meet.
PARTS = 16
#: Postings, or pairs of postings and items, that a task works on at a time (a row with more by itself).
POSTINGS = 500_000


class Block:
    """The terms of some items: numbered, and for each item in a row of ``item`` and ``term`` entries."""

    def __init__(self, ids: list, terms: list[set[bytes]]):
        self.ids = ids
        self.term_of = {t: i for i, t in enumerate(sorted(set().union(*terms)))}
        self.item = np.repeat(np.arange(len(ids)), [len(x) for x in terms])
        self.term = np.fromiter((self.term_of[t] for x in terms for t in sorted(x)), np.int64, len(self.item))


def item_blocks(items: DataFrame, block_bytes: int, id_col: str = "item_id", text_col: str = "text") -> Iterator[Block]:
    """Items in blocks of at most ``block_bytes`` of text; an item with more is a block by itself."""
    ids: list = []
    terms: list[set[bytes]] = []
    n = 0
    for r in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").orderBy("i").toLocalIterator():
        text = r.t.encode()
        found = set(W.folded_words(text))
        if ids and ids[-1] == r.i:
            terms[-1] |= found
        else:
            if ids and n + len(text) > block_bytes:
                yield Block(ids, terms)
                ids, terms, n = [], [], 0
            ids.append(r.i)
            terms.append(found)
        n += len(text)
    if ids:
        yield Block(ids, terms)


def hits(docs: DataFrame, block: Block, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored, one row per document: doc_id, n (its terms with repeats), term and tf (arrays: the numbers of the block's terms in it, and how often)."""
    sent = docs.sparkSession.sparkContext.broadcast(block.term_of)  # at most a block's bytes of text
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("term", "tf"))])
    lists = pa.list_(pa.int32())

    def work(batches):
        term_of = sent.value
        for batch in batches:
            for a, b in W.row_slices(batch.column(1)):
                part = batch.slice(a, b - a)
                data, off = W.column_bytes(part.column(1))
                whole, off = data.tobytes(), off.tolist()
                n, term, tf = [], [], []
                for x, y in zip(off[:-1], off[1:], strict=True):
                    words = W.folded_words(whole[x:y])
                    count = Counter(filter(term_of.__contains__, words))
                    n.append(len(words))
                    term.append([term_of[t] for t in count])
                    tf.append(list(count.values()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(term, lists), pa.array(tf, lists)], names=schema.names)

    return stored(docs.select(id_col, text_col).mapInArrow(work, schema), "hits")


def _saturated(tf: np.ndarray, n: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """What a term's weight is multiplied by; ``n``: the document's length."""
    m = 50 + (50 * n * n_docs) // max(1, all_terms)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _postings(batch: pa.RecordBatch, size: tuple[int, int], cost: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows a to b of a batch of hits, and their postings: row (from 0 at a), term, and what its weight is multiplied by.

    ``cost``: for each term, what a posting of it counts besides itself.
    """
    off = np.concatenate([[0], np.cumsum(batch.column("term").value_lengths().to_numpy(zero_copy_only=False))])
    term, tf = (batch.column(c).flatten().to_numpy() for c in ("term", "tf"))
    n = batch.column("n").to_numpy()
    spent = off if cost is None else off + np.concatenate([[0], np.cumsum(cost[term])])[off]
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(spent, spent[a] + POSTINGS, "right")) - 1)
        row = np.repeat(np.arange(b - a), np.diff(off[a : b + 1]))
        yield a, b, row, term[off[a] : off[b]].astype(np.int64), _saturated(tf[off[a] : off[b]].astype(np.int64), n[a:b][row], *size)
        a = b


def term_impacts(found: DataFrame, size: tuple[int, int], best: int = BEST) -> DataFrame:
    """Stored, one row per term: term, df, weight, most (the largest impact), kth (the ``best``-th largest; 0 if there are fewer)."""
    n_docs, _ = size

    def work(batches):
        term, value, df = np.zeros(0, np.int64), np.zeros(0, np.int64), Counter()
        for batch in batches:
            for _, _, _, t, g in _postings(batch, size):
                df.update(dict(zip(*(x.tolist() for x in np.unique(t, return_counts=True)), strict=True)))
                term, value = np.concatenate([term, t]), np.concatenate([value, g])
                order = np.lexsort((-value, term))
                term, value = term[order], value[order]
                place = np.arange(len(term)) - np.searchsorted(term, term)
                term, value = term[place < best], value[place < best]
        first = np.searchsorted(term, term) == np.arange(len(term))
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(value), pa.array([df[t] if f else 0 for t, f in zip(term.tolist(), first.tolist(), strict=True)], pa.int64())], names=["term", "value", "df"])

    tops = found.select("n", "term", "tf").mapInArrow(work, "term long, value long, df long")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.col("value").desc()))
    ranked = tops.withColumn("place", place).groupBy("term").agg(F.sum("df").alias("df"), F.max("value").alias("most"), F.coalesce(F.max(F.when(F.col("place") == best, F.col("value"))), F.lit(0)).alias("kth"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    return stored(ranked.withColumn("weight", weight).select("term", "df", "weight", (F.col("weight") * F.col("most")).alias("most"), (F.col("weight") * F.col("kth")).alias("kth")), "impacts")


class Bounds:
    """The entries of a block's items in order of rising largest impact, with the suffix bound at each."""

    def __init__(self, block: Block, impacts: pa.Table, best: int):
        n = len(block.term_of)
        self.best, self.n_items = best, len(block.ids)
        self.weight, most, kth = (np.zeros(n, np.int64) for _ in range(3))
        at = impacts.column("term").to_numpy()
        for own, c in ((self.weight, "weight"), (most, "most"), (kth, "kth")):
            own[at] = impacts.column(c).to_numpy()
        use = most[block.term] > 0  # others add nothing to any score
        item, term = block.item[use], block.term[use]
        order = np.lexsort((term, most[term], item))
        self.item, self.term = item[order], term[order]
        self.begin = np.searchsorted(self.item, np.arange(self.n_items + 1))
        upto = np.concatenate([[0], np.cumsum(most[self.term])])
        self.upto = upto[1:] - upto[self.begin[self.item]]
        self.seed = np.zeros(self.n_items, np.int64)
        np.maximum.at(self.seed, self.item, kth[self.term])

    def split(self, least: np.ndarray) -> None:
        """Generate from entries whose bound reaches the items' thresholds; the others are ``rest``, at most ``slack`` together."""
        on = self.upto >= least[self.item]
        order = np.argsort(self.term[on], kind="stable")
        self.by_term, self.of = self.term[on][order], self.item[on][order]
        self.from_, self.to = (np.searchsorted(self.by_term, np.arange(len(self.weight)), side) for side in ("left", "right"))
        self.slack = np.zeros(self.n_items, np.int64)
        np.maximum.at(self.slack, self.item[~on], self.upto[~on])
        self.rest = np.zeros(self.n_items, np.int64)  # how many of an item's first entries generate nothing
        np.add.at(self.rest, self.item[~on], 1)

    def scores(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and exact score of every pair that may reach its item's threshold."""
        many = self.to[term] - self.from_[term]
        which = np.repeat(np.arange(len(term)), many)
        item = self.of[np.arange(len(which)) + np.repeat(self.from_[term] - (np.cumsum(many) - many), many)]
        key, inverse = np.unique(row[which] * self.n_items + item, return_inverse=True)
        score = np.zeros(len(key), np.int64)
        np.add.at(score, inverse, (self.weight[term] * value)[which])
        r, i = key // self.n_items, key % self.n_items
        live = score + self.slack[i] >= least[i]
        r, i, score = r[live], i[live], score[live]
        # the entries that generated nothing, looked up in the row's postings
        place = row * len(self.weight) + term
        order = np.argsort(place)
        place, worth = place[order], (self.weight[term] * value)[order]
        many = self.rest[i]
        pair = np.repeat(np.arange(len(i)), many)
        want = r[pair] * len(self.weight) + self.term[np.arange(len(pair)) + np.repeat(self.begin[i] - (np.cumsum(many) - many), many)]
        at = np.minimum(np.searchsorted(place, want), max(0, len(place) - 1))
        there = place[at] == want if len(place) else np.zeros(0, bool)
        np.add.at(score, pair[there], worth[at[there]])
        live = (score >= least[i]) & (score > 0)
        return r[live], i[live], score[live]


def _best(rows: pa.Table, best: int) -> pa.Table:
    """The ``best`` rows of each item; null ids last."""
    rows = rows.sort_by([("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")])
    item = rows.column("item").to_numpy()
    return rows.filter(pa.array(np.arange(len(item)) - np.searchsorted(item, item) < best))


def _block_best(docs: DataFrame, block: Block, best: int) -> DataFrame:
    """item (its number in the block), doc_id, score: a superset of the best of each item, ``best`` a task at most."""
    found = hits(docs, block)
    size = found.agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    size = (size[0], size[1])
    bounds = Bounds(block, term_impacts(found, size, best).toArrow(), best)  # a row for each term of the block
    sent = docs.sparkSession.sparkContext.broadcast(bounds)
    schema = T.StructType([T.StructField("item", T.IntegerType()), found.schema["doc_id"], T.StructField("score", T.LongType())])

    def work(batches):
        own = copy(sent.value)
        top, least = None, own.seed
        own.split(least)
        for batch in batches:
            for a, b, row, term, value in _postings(batch, size, own.to - own.from_):
                r, i, score = own.scores(row, term, value, least)
                new = pa.table({"item": pa.array(i, pa.int32()), "doc_id": batch.column("doc_id").slice(a, b - a).take(pa.array(r)), "score": score})
                top = _best(new if top is None else pa.concat_tables([top, new]), own.best)
                item = top.column("item").to_numpy()
                last = np.flatnonzero(np.arange(len(item)) - np.searchsorted(item, item) == own.best - 1)
                higher = least.copy()
                higher[item[last]] = np.maximum(least[item[last]], top.column("score").to_numpy()[last])
                if (higher > least).any():
                    least = higher
                    own.split(least)
        if top is not None:
            yield from top.combine_chunks().to_batches()

    return found.where(F.size("term") > 0).select("doc_id", "n", "term", "tf").mapInArrow(work, schema)


def _ranked(rows: DataFrame, best: int) -> DataFrame:
    """The best of each item with their rank; an item's rows meet in parts first."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    few = rows.withColumn("place", F.row_number().over(Window.partitionBy("item", part).orderBy(*order))).where(F.col("place") <= best).drop("place")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= best)


def search(docs: DataFrame, items: DataFrame, best: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``best`` documents of each item with a score above 0, highest first."""
    kind = items.schema["item_id"]
    out = docs.sparkSession.createDataFrame([], T.StructType([kind, T.StructField("rank", T.IntegerType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())]))
    for block in item_blocks(items, block_bytes):
        found = stored(_ranked(_block_best(docs, block, best), best), "ranked")
        names = docs.sparkSession.createDataFrame(list(enumerate(block.ids)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind.dataType)]))
        out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score"))  # at most a block's items
    return out


#: The same in DuckDB.
ORACLE_SQL = r"""
with folded as (select doc_id, row_number() over () as r, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
words as (select doc_id, r, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from folded),
post as (select any_value(doc_id) as doc_id, r, term, count(*) as tf from words group by r, term),
lens as (select r, sum(tf)::bigint as n from post group by r),
total as (select count(*)::bigint as n_docs, sum(n)::bigint as all_terms from lens),
items as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
held as (select term, count(*) as df from post where term in (select term from items) group by term),
weights as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) as w from held, total),
scores as (select i.item_id, p.doc_id, p.r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // all_terms))))::bigint as score
 from post p join weights using (term) join items i using (term) join lens using (r), total group by i.item_id, p.doc_id, p.r),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from ranked where rank <= 50
"""
