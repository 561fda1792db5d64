"""Near-duplicate classes by improved consistent weighted sampling.

1. Document frequencies.  Shingles of five words are hashed into ``BUCKETS`` features, and
   their document frequencies are counted over all documents.  The number of features is
   fixed (the hashing trick), so the table sent to the tasks is as large for any corpus,
   and a feature's share of documents does not change as the corpus grows.
2. Signatures.  A shingle weighs its count in the text times its feature's inverse document
   frequency.  Improved consistent weighted sampling draws ``BANDS * ROWS`` samples of
   (shingle, level) a document; two documents agree on a sample as often as their weighted
   Jaccard similarity says.
3. Equal texts become one node.  Nodes that agree on all rows of a band share a bucket.
4. Verification.  Small buckets with the same nodes are looked at once.  In each bucket the node
   that shares most with others is the first pivot; all others are compared with it.  While a
   bucket has more than ``MANY_APART`` nodes that are not similar to any pivot, one of them is the
   next pivot and is compared with the whole bucket, up to ``PIVOTS`` times.  Nodes that the links
   so far connect, in whatever bucket, need no more comparisons.  The others are dealt into cells:
   one minus the similarity is a metric, so two nodes whose distances to a pivot differ by more
   than one minus the threshold cannot be similar, and only nodes of cells that touch are compared,
   in blocks of bounded size.  So every two nodes of a bucket are compared, proved dissimilar or
   connected already; a family of copies costs as many links as it has members, and a block writes
   no more links than connect what it found.
5. Classes are the connected components of the links.

Defined cases: a null text, or one without a word, has a class of its own; shorter texts have
one shingle of all their words; very long texts are compared whole, in blocks of few; of repeated
rows or ids all get the same class; a class is named by its smallest doc_id (null ids do not name
one); ties of pivots go to the smallest node; columns of any name are kept as they are; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import small_or_join, stored
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
#: Hashed features, as a power of two.
FEATURE_BITS = 18
BANDS, ROWS = 14, 4
#: Pivots of a bucket at most, and nodes without a similar pivot that ask for one more.
PIVOTS = 8
MANY_APART = 1_000
#: Pivots by whose distances cells are made.
CELL_PIVOTS = 2
#: Nodes of a bucket that need no cells.
SMALL_BUCKET = 64
#: Shingles of one side in a block of comparisons, about; long texts make blocks of few nodes.
BLOCK_SHINGLES = 1 << 17
#: Shingles of one side that are compared at a time.
STEP_SHINGLES = 1 << 18
#: Slim rows (an id or a digest) that may be broadcast.
SLIM_ROWS = 100_000
_HASH_BITS = 48
_TABLE_BITS = 16


def document_shingles(col: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct 48-bit shingle hashes of each row, their counts, and the bounds by row."""
    data, off = W.column_bytes(col)
    s, e, bounds = W.word_spans(data, off, W.ALNUM)
    h, at = W.shingle_hashes(W.word_hashes(data, s, e), bounds, k)
    row = np.repeat(np.arange(len(off) - 1, dtype=np.uint64), np.diff(at))
    both = (row << np.uint64(_HASH_BITS)) | (h >> np.uint64(64 - _HASH_BITS))
    both.sort()
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    first = np.flatnonzero(new)
    one = both[first]
    count = np.diff(np.append(first, len(both)))
    bounds = np.searchsorted(one >> np.uint64(_HASH_BITS), np.arange(len(off), dtype=np.uint64))
    return one & np.uint64((1 << _HASH_BITS) - 1), count, bounds


def _feature(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(_HASH_BITS - bits)).astype(np.int64)


def inverse_frequencies(docs: DataFrame, bits: int = FEATURE_BITS) -> np.ndarray:
    """ln((n + 1) / (df + 1)) + 1 of each feature, over all documents with a word; 2**bits numbers whatever the corpus."""

    def count(batches):
        seen, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for a, b in W.row_slices(batch.column(0)):
                h, _, bounds = document_shingles(batch.column(0).slice(a, b - a))
                # a document counts once for a feature, though two of its shingles fall there
                row = np.repeat(np.arange(b - a), np.diff(bounds))
                f = _feature(h, bits)
                new = np.ones(len(f), bool)
                new[1:] = (f[1:] != f[:-1]) | (row[1:] != row[:-1])  # sorted hashes have sorted features
                seen += np.bincount(f[new], minlength=1 << bits)
                n += int((np.diff(bounds) > 0).sum())
        f = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(f, -1)), pa.array(np.append(seen[f], n))], names=["feature", "n"])

    got = docs.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    n = int(got.n[got.feature == -1].sum())
    df = np.zeros(1 << bits)
    real = got[got.feature >= 0]
    df[real.feature.to_numpy()] = real.n.to_numpy()
    return (np.log((n + 1) / (df + 1)) + 1).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling.  The random triples (r, c, beta) of a shingle come from a table of 2**16, at a place that a hash for each sample gives."""

    def __init__(self, samples: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = 1 << _TABLE_BITS
        r = rng.gamma(2.0, 1.0, n)
        self.r = r.astype(np.float32)
        self.over_r = (1 / r).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, n)).astype(np.float32)
        self.beta = rng.uniform(0, 1, n).astype(np.float32)
        self.factor = rng.integers(1 << 62, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sample(self, h: np.ndarray, log_w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each sample and document, a 32-bit name of the (shingle, level) drawn; documents begin at ``starts`` and are not empty."""
        out = np.empty((len(self.factor), len(starts)), np.uint64)
        with np.errstate(over="ignore"):
            for k, factor in enumerate(self.factor):
                x = h * factor
                at = (x >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
                r, beta = self.r[at], self.beta[at]
                level = np.floor(log_w * self.over_r[at] + beta)
                log_a = self.log_c[at] - r * (level - beta + np.float32(1))
                # positive floats are ordered as their bits are
                order = (log_a + np.float32(128)).view(np.uint32).astype(np.uint64) << np.uint64(32)
                name = (x ^ (level.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)
                out[k] = np.minimum.reduceat(order | name, starts)
        return out & np.uint64(0xFFFFFFFF)


def signatures(docs: DataFrame, idf: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, key (digest of the text), bands (a hash for each; null without a word)."""
    sent = docs.sparkSession.sparkContext.broadcast(idf)
    bits = len(idf).bit_length() - 1
    schema = T.StructType([docs.schema["doc_id"], T.StructField("key", T.StringType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def sign(batches):
        sampler, weight = Sampler(bands * rows), sent.value
        for batch in batches:
            for a, b in W.row_slices(batch.column(2)):
                part = batch.slice(a, b - a)
                h, count, bounds = document_shingles(part.column(2))
                some = np.diff(bounds) > 0
                found = np.full((b - a, bands), 0, np.int64)
                if some.any():
                    log_w = np.log(weight[_feature(h, bits)] * count.astype(np.float32))
                    drawn = sampler.sample(h, log_w, bounds[:-1][some])
                    for i in range(bands):
                        x = np.full(drawn.shape[1], i + 1, np.uint64)
                        for row in drawn[i * rows : (i + 1) * rows]:
                            x = W.mix(x * np.uint64(0x9E3779B97F4A7C15) + row)
                        found[some, i] = x.view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * bands), pa.array(found.ravel()), mask=pa.array(~some))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=schema.names)

    return docs.select("doc_id", F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32).alias("key"), "text").mapInArrow(sign, schema)


def vectors(rows: DataFrame) -> DataFrame:
    """node, n, vec: the sorted shingle hashes of ``text``, each as often as it stands there (n times 8 bytes)."""

    def work(batches):
        for batch in batches:
            for a, b in W.row_slices(batch.column(1)):
                part = batch.slice(a, b - a)
                h, count, bounds = document_shingles(part.column(1))
                ends = np.concatenate([[0], np.cumsum(count)])[bounds].tolist()
                whole = np.repeat(h, count)
                vecs = [whole[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends)), pa.array(vecs, pa.binary())], names=["node", "n", "vec"])

    return rows.select("node", "text").mapInArrow(work, "node long, n long, vec binary")


def _weights(vecs: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, weights and owners of all vectors, and each vector's total."""
    bits = len(idf).bit_length() - 1
    all_h, all_w, owner, total = [], [], [], []
    for i, v in enumerate(vecs):
        h, count = np.unique(np.frombuffer(v, np.uint64), return_counts=True)
        w = idf[_feature(h, bits)].astype(np.float64) * count
        all_h.append(h)
        all_w.append(w)
        owner.append(np.full(len(h), i))
        total.append(w.sum())
    return np.concatenate(all_h), np.concatenate(all_w), np.concatenate(owner), np.array(total)


def similar(probes: list[bytes], members: list[bytes], idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities, probes by members."""
    h, w, owner, total = _weights(members, idf)
    order = np.argsort(h, kind="stable")
    h, w, owner = h[order], w[order], owner[order]
    ph, pw, pi, ptotal = _weights(probes, idf)
    lo, hi = np.searchsorted(h, ph, "left"), np.searchsorted(h, ph, "right")
    out = np.zeros((len(probes), len(members)))
    edges = np.searchsorted(pi, np.arange(len(probes) + 1))
    for i in range(len(probes)):
        a, b = edges[i], edges[i + 1]
        n = hi[a:b] - lo[a:b]
        at = np.arange(n.sum()) + np.repeat(lo[a:b] - (np.cumsum(n) - n), n)
        common = np.bincount(owner[at], np.minimum(w[at], np.repeat(pw[a:b], n)), len(members))
        out[i] = common / (ptotal[i] + total - common)
    return out


def _steps(vecs: list[bytes]) -> list[tuple[int, int]]:
    """Ranges of vectors of at most STEP_SHINGLES together, or of one."""
    ends = np.cumsum([len(v) // 8 for v in vecs])
    out, a = [], 0
    while a < len(vecs):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP_SHINGLES, "right")))
        out.append((a, b))
        a = b
    return out


class Forest:
    """Which of some nodes are connected."""

    def __init__(self, nodes):
        self.parent = {int(x): int(x) for x in nodes}

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        """True if they were apart."""
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _all_similarities(left: pd.DataFrame, right: pd.DataFrame, idf: np.ndarray) -> list[tuple]:
    """a, b and similarity of every probe and member."""
    lv, rv, ln, rn = list(left.vec), list(right.vec), left.node.to_numpy(), right.node.to_numpy()
    out = []
    for p0, p1 in _steps(lv):
        for m0, m1 in _steps(rv):
            s = similar(lv[p0:p1], rv[m0:m1], idf)
            out.append((np.repeat(ln[p0:p1], m1 - m0), np.tile(rn[m0:m1], p1 - p0), s.ravel()))
    return out


def _connecting(left: pd.DataFrame, right: pd.DataFrame, idf: np.ndarray, similarity: float) -> list[tuple]:
    """Links between nodes of different owners that connect all that are similar; nodes of one owner are connected already."""
    forest = Forest([*left.owner, *right.owner])
    often = left.owner.map(left.owner.value_counts()) > 8  # no need to compare these with their like
    parts = [(left[~often], right)] + [(p, right[right.owner != owner]) for owner, p in left[often].groupby("owner")]
    out = []
    for probes, members in parts:
        pv, mv, pn, mn, po, mo = list(probes.vec), list(members.vec), probes.node.tolist(), members.node.tolist(), probes.owner.to_numpy(), members.owner.to_numpy()
        for p0, p1 in _steps(pv):
            for m0, m1 in _steps(mv):
                s = similar(pv[p0:p1], mv[m0:m1], idf)
                s[po[p0:p1, None] == mo[None, m0:m1]] = 0
                new = [(pn[x + p0], mn[y + m0], s[x, y]) for x, y in zip(*np.nonzero(s >= similarity), strict=True) if forest.join(int(po[x + p0]), int(mo[y + m0]))]
                out += [tuple(np.array(c) for c in zip(*new, strict=True))] if new else []
    return out


def compared(probes: DataFrame, members: DataFrame, vecs: DataFrame, idf: np.ndarray, similarity: float | None = None, block: int = BLOCK_SHINGLES) -> DataFrame:
    """g, a, b, s: of ``probes`` and ``members`` (both g, node, owner, n: shingles) of the same g, all similarities, or only links enough to connect those of ``similarity`` or more.

    Both sides are dealt into blocks of about ``block`` shingles, and each task compares one
    block of either.
    """
    sent = vecs.sparkSession.sparkContext.broadcast(idf)
    blocks = lambda df, name: df.groupBy("g").agg(F.greatest(F.ceil(F.sum("n") / F.lit(block)), F.lit(1)).cast("int").alias(name))
    sizes = stored(blocks(probes, "np").join(blocks(members, "nm"), "g"), "block-sizes")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    p = small_or_join(probes, sizes, "g", "inner", SLIM_ROWS).select("g", own("np").alias("i"), every("nm").alias("j"), "node", "owner", F.lit(True).alias("probe"))
    m = small_or_join(members, sizes, "g", "inner", SLIM_ROWS).select("g", every("np").alias("i"), own("nm").alias("j"), "node", "owner", F.lit(False).alias("probe"))

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows.probe], rows[~rows.probe]
        found = []
        if len(left) and len(right):
            found = _all_similarities(left, right, sent.value) if similarity is None else _connecting(left, right, sent.value, similarity)
        a, b, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        keep = a != b
        return pd.DataFrame({"g": np.full(keep.sum(), rows.g.iloc[0]), "a": a[keep], "b": b[keep], "s": s[keep]})

    return p.unionByName(m).join(vecs.select("node", "vec"), "node").groupBy("g", "i", "j").applyInPandas(work, "g long, a long, b long, s double")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """h, node, n (nodes of the bucket) of all buckets with two nodes or more; of small ones with the same nodes only one."""
    rows = nodes.select("node", F.explode("bands").alias("h"))
    counted = rows.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.min("node").alias("least"), F.max("node").alias("most")).where("n > 1")
    same = F.when(F.col("n") <= SMALL_BUCKET, F.struct("n", "sum", "least", "most")).otherwise(F.struct("n", F.col("h").cast("decimal(38,0)").alias("sum"), F.lit(0).cast("long").alias("least"), F.lit(0).cast("long").alias("most")))
    shared = stored(counted.groupBy(same.alias("same")).agg(F.min("h").alias("h"), F.first("n").alias("n")).select("h", "n"), "buckets")
    return stored(small_or_join(rows, shared, "h", "inner", SLIM_ROWS), "members")


def _linked(nodes: DataFrame, docs: DataFrame, idf: np.ndarray, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (a, b) of nodes with pivots, the labels of what they connect, and links between such parts."""
    members = shared_buckets(nodes)
    active = stored(nodes.join(members.select("node"), "node", "left_semi").select("node", "key", F.col("doc_id").alias("_first")), "active")
    text = docs.select(F.col("doc_id").alias("_first"), F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32).alias("key"), "text")
    of_key = small_or_join(text, active.withColumnRenamed("_first", "_want"), "key", "inner", SLIM_ROWS).where(F.col("_first").eqNullSafe(F.col("_want")))
    vecs = stored(vectors(of_key).dropDuplicates(["node"]), "vectors")

    # nodes of a bucket that have not been its pivot; near: similar to one of its pivots; at: distances to them
    centre = F.sum("n").over(Window.partitionBy("node"))  # a node is in as many buckets as there are bands at most
    central = members.select("h", "node", centre.alias("centre")).join(vecs.select("node", "n"), "node")
    state = stored(central.select("h", "node", "n", "centre", F.lit(False).alias("near"), F.array().cast("array<double>").alias("at")), "starred")
    found, left = [], []
    for k in range(PIVOTS):
        hubs = state.where("not near").groupBy("h").agg(F.max_by("node", F.struct("centre", -F.col("node"))).alias("hub"))
        others = stored(state.join(hubs, "h").where("node <> hub"), "with-hubs")
        pairs = stored(others.select(F.col("hub").alias("g"), "node", F.col("node").alias("owner"), "n").dropDuplicates(["g", "node"]), "pairs")
        hub = pairs.select("g").distinct().select("g", F.col("g").alias("node"), F.col("g").alias("owner"), F.lit(1).alias("n"))  # a block by itself
        close = stored(compared(hub, pairs, vecs, idf).select(F.col("a").alias("hub"), F.col("b").alias("node"), "s"), "similarities")
        found.append(close.where(F.col("s") >= similarity).select(F.col("hub").alias("a"), F.col("node").alias("b")))
        s = F.coalesce("s", F.lit(0.0))
        state = stored(others.join(close, ["hub", "node"], "left").select("h", "node", "n", "centre", (F.col("near") | (s >= similarity)).alias("near"), F.array_append("at", 1 - s).alias("at")), "after-pivot")
        # a node that is left alone has been compared with all; where all are near the one pivot, all are connected
        kinds = stored(state.groupBy("h").agg(F.count("*").alias("n"), F.count_if(~F.col("near")).alias("apart")).where("n > 1" if k else "n > 1 and apart > 0"), "kinds")
        many = kinds.where(F.col("apart") > MANY_APART)
        last = k == PIVOTS - 1 or not many.limit(1).count()
        left.append(state.join((kinds if last else kinds.where(F.col("apart") <= MANY_APART)).select("h"), "h", "left_semi").select("h", "node", "n", "at"))
        if last:
            break
        state = stored(state.join(many.select("h"), "h", "left_semi"), "open")
    rest, out = state.limit(0).select("h", "node", "n", "at"), found[0]
    for x in left:
        rest = rest.unionByName(x)
    for x in found[1:]:
        out = out.union(x)
    out = stored(out.distinct(), "pivot-links")
    labels = components(out)
    owners = rest.join(labels.withColumnRenamed("label", "owner"), "node", "left").select("h", "node", "n", "at", F.coalesce("owner", "node").alias("owner"))
    return out, labels, stored(across_cells(stored(owners, "mixed"), vecs, idf, similarity).select("a", "b").distinct(), "cell-links")


def links(nodes: DataFrame, docs: DataFrame, idf: np.ndarray, similarity: float = SIMILARITY) -> DataFrame:
    """a, b: verified links that connect all similar nodes that share a bucket."""
    first, _, second = _linked(nodes, docs, idf, similarity)
    return first.union(second).distinct()


def connected(nodes: DataFrame, docs: DataFrame, idf: np.ndarray, similarity: float = SIMILARITY) -> DataFrame:
    """node, label of all nodes with a link.  What the pivots connect is one node already where the cells' links are followed."""
    _, labels, second = _linked(nodes, docs, idf, similarity)
    if not second.limit(1).count():
        return labels
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    lifted = second.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    above = components(lifted).select(F.col("node").alias("label"), F.col("label").alias("far"))
    whole = labels.join(above, "label", "left").select("node", F.coalesce("far", "label").alias("label"))
    return whole.unionByName(above.join(labels, above["label"] == labels["node"], "left_anti").select(F.col("label").alias("node"), F.col("far").alias("label")))


def across_cells(mixed: DataFrame, vecs: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """Links between nodes (h, node, n, owner, at: distances to the bucket's pivots) of a bucket that have different owners.

    Distances are cut into steps of one minus ``similarity``; similar nodes are in the same step or in
    neighbours, for every pivot.  Members stay in their cell, probes (all but those of the bucket's
    first owner) go to all cells around theirs.  A small bucket is one cell.
    """
    width = (1 - similarity) * (1 + 1e-9)
    sizes = mixed.groupBy("h").agg(F.min("owner").alias("main"), F.max("owner").alias("most"), F.count("*").alias("size"))
    worth = stored(sizes.where("main <> most").drop("most"), "mixed-buckets")
    cell = F.transform(F.slice("at", 1, CELL_PIVOTS), lambda d: F.floor(d / F.lit(width)).cast("int"))
    cells = mixed.join(worth, "h").withColumn("cell", F.when(F.col("size") > SMALL_BUCKET, cell).otherwise(F.array().cast("array<int>")))
    around = F.array(F.array().cast("array<int>"))
    for i in range(CELL_PIVOTS):
        step = lambda have, i=i: F.flatten(F.transform(have, lambda head: F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.array_append(head, F.get("cell", F.lit(i)) + d))))
        around = F.when(F.size("cell") > i, step(around)).otherwise(around)
    group = lambda cell: F.xxhash64("h", F.concat_ws(",", F.transform(cell, lambda x: x.cast("string")))).alias("g")
    members = stored(cells.select(group(F.col("cell")), "node", "owner", "n"), "cell-members")
    probes = cells.where("owner <> main").select("h", "node", "owner", "n", F.explode(around).alias("cell")).select(group(F.col("cell")), "node", "owner", "n")
    # a probe stays where a member of another owner is
    kinds = stored(members.groupBy("g").agg(F.min("owner").alias("least"), F.max("owner").alias("most")), "cells")
    probes = stored(probes.join(kinds, "g").where("owner <> least or owner <> most").drop("least", "most"), "cell-probes")
    return compared(probes, members.join(probes.select("g").distinct(), "g", "left_semi"), vecs, idf, similarity)


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class) and text_key (a digest of its text)."""
    idf = inverse_frequencies(docs)
    signed = stored(signatures(docs, idf), "signatures")
    node = signed.where("bands is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    nodes = stored(node.withColumn("node", F.monotonically_increasing_id()), "nodes")
    linked = connected(nodes, docs, idf, similarity)
    named = nodes.join(linked, "node", "left").select("key", "doc_id", F.coalesce("label", "node").alias("label"))
    named = stored(named, "named")
    name = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    of_key = stored(named.join(name, "label").select("key", "class_id"), "class-of-key")
    out = small_or_join(signed, of_key, "key", "left", SLIM_ROWS)
    return out.select("doc_id", F.when(F.col("bands").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.col("key").alias("text_key"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class: that which names it.

    Of repeated rows of one id and text one stays; rows without an id stay.
    """
    found = stored(classes(docs, similarity).select("doc_id", "class_id"), "classes")
    gone = stored(found.where("doc_id <> class_id").select("doc_id").distinct(), "copies")
    left = small_or_join(docs, gone, "doc_id", "left_anti", SLIM_ROWS)
    again = stored(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if not again.limit(1).count():
        return left
    once = small_or_join(left, again, "doc_id", "left_semi", SLIM_ROWS).dropDuplicates(["doc_id", "text"])
    return small_or_join(left, again, "doc_id", "left_anti", SLIM_ROWS).unionByName(once)
