"""Target-distribution importance resampling over hashed n-grams.

Each task cuts its rows into slices, numbers the slice's words and sorts a suffix array of the
word ids.  Suffixes that share their first n words stand next to each other: each such run, found
by the longest common prefix of neighbours, is one n-gram, hashed once; its bucket is scattered
back to all places of the run.  A document's buckets are stored (two bytes a feature), so texts
are read and sorted once.

Counts are summed in each task before they are shuffled, one row for each bucket.  The gains of the
buckets are a table of fixed size, whatever the corpus; documents are scored by it where they lie.
The draw is a sort over range partitions (rows are split by place where all else is equal), so no
task holds a ranking.

Defined cases: null, empty and wordless texts have no features and weight 0; a text of fewer than
three words has only the runs that fit; a very long text is a slice of its own; repeated rows are
documents of their own, drawn by themselves; equal scores go by doc_id, nulls first, and a null id
hashes as an empty string; other columns are not read; an empty table gives no rows, and an empty
target gives gains of the corpus alone.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import words as W
from .common import stored
from .decontaminate import suffix_array
from .sharding import dealt_in_runs

BUCKETS = 10_000
#: Words in the longest feature.
LONGEST = 3
#: Bytes of text in one suffix array; a longer text has one of its own.
SLICE_BYTES = 4 << 20
#: Checksums of words up to this length are put together by table, those of longer ones are taken from the bytes.
TABLED = 254


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """For each length, what that many zero bytes make of the four bytes of a checksum (a linear map): 4 times 256 values."""
    zero = np.array([~zlib.crc32(b"\0", ~c & 0xFFFFFFFF) & 0xFFFFFFFF for c in range(256)], np.uint32)
    out = np.empty((TABLED + 2, 1024), np.uint32)
    out[0] = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])
    for n in range(1, len(out)):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ zero[out[n - 1] & np.uint32(255)]
    return out


def joined_crc(first: np.ndarray, then: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two byte strings one after the other, from that of each and the second's length (``TABLED`` + 1 at most)."""
    table, base = _shifts().reshape(-1), length.astype(np.int64) * 1024
    for j in range(4):
        then = then ^ table[base + (256 * j) + ((first >> np.uint32(8 * j)) & np.uint32(255))]
    return then


class Slice:
    """The word ids of some texts and the buckets of their n-grams."""

    def __init__(self, texts: list[bytes], buckets: int = BUCKETS):
        ids: defaultdict[bytes, int] = defaultdict()
        ids.default_factory = ids.__len__
        found = [W.folded_words(t) for t in texts]
        self.n = np.array([len(x) for x in found], np.int64)
        at = np.concatenate([[0], np.cumsum(self.n + 1)])
        self.first = at[:-1]
        w = np.full(at[-1] + LONGEST, 0xFFFFFFFF, np.uint32)  # a word that is none ends each text
        for a, x in zip(self.first.tolist(), found, strict=True):
            w[a : a + len(x)] = np.fromiter(map(ids.__getitem__, x), np.uint32, len(x))
        del found
        self.vocabulary = list(ids)
        end = np.repeat(self.first + self.n, self.n + 1)
        sa, _ = suffix_array(w[: at[-1]], LONGEST) if at[-1] else (np.zeros(0, np.int64), None)
        self.bucket = [np.zeros(len(sa), np.uint16) for _ in range(LONGEST)]
        same = np.zeros(len(sa), bool)
        same[1:] = True
        for k in range(LONGEST):
            same[1:] &= w[sa[1:] + k] == w[sa[:-1] + k]  # the common prefix with the suffix before is longer than k
            real = sa + k < end[sa]
            start = real & ~same
            crc = self._crc(w, sa[start], k + 1)
            self.bucket[k][sa[real]] = (crc % np.uint32(buckets)).astype(np.uint16)[np.cumsum(start)[real] - 1]

    def _crc(self, w: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """CRC-32 of the n words from each place on, joined by a blank."""
        if n == 1:
            self.length = np.array([len(x) for x in self.vocabulary], np.int64)
            self.crc = np.fromiter(map(zlib.crc32, self.vocabulary), np.uint32, len(self.vocabulary))
            blank = np.full(len(self.crc), zlib.crc32(b" "), np.uint32)
            self.spaced = joined_crc(self.crc, blank, np.ones(len(blank), np.int64))
            return self.crc[w[at]]
        size = np.minimum(self.length, TABLED)
        out = self.spaced[w[at]]
        for k in range(1, n):
            word = w[at + k]
            out = joined_crc(out, self.crc[word], size[word]) if k == n - 1 else joined_crc(out, self.spaced[word], size[word] + 1)
        for i in np.flatnonzero(np.logical_or.reduce([self.length[w[at + k]] > TABLED for k in range(1, n)])).tolist():
            out[i] = zlib.crc32(b" ".join(self.vocabulary[x] for x in w[at[i] : at[i] + n].tolist()))
        return out

    def features(self) -> list[bytes]:
        """The buckets of each text's features, two bytes each."""
        return [b"".join(x[a : max(a, a + n - k)].tobytes() for k, x in enumerate(self.bucket)) for a, n in zip(self.first.tolist(), self.n.tolist(), strict=True)]


def slices(text: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    for a, b in W.row_slices(text, SLICE_BYTES):
        data, off = W.column_bytes(text.slice(a, b - a))
        whole, off = data.tobytes(), off.tolist()
        yield a, b, [whole[x:y] for x, y in zip(off[:-1], off[1:], strict=True)]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Stored, one row per document: its id, n_words, buckets (binary, 16 bits a feature); and one row per task with counts (binary, 64 bits a bucket)."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket has 16 bits")
    schema = T.StructType([docs.schema[id_col], *(T.StructField(*x) for x in (("n_words", T.LongType()), ("buckets", T.BinaryType()), ("counts", T.BinaryType())))])
    kind = to_arrow_type(docs.schema[id_col].dataType)

    def work(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                one = Slice(texts, buckets)
                found = one.features()
                counts += np.bincount(np.frombuffer(b"".join(found), np.uint16), minlength=buckets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(one.n), pa.array(found, pa.binary()), pa.nulls(b - a, pa.binary())], names=schema.names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=schema.names)

    return stored(docs.select(id_col, text_col).mapInArrow(work, schema), "features")


def bucket_counts(found: DataFrame) -> DataFrame:
    """bucket, n: how many features of all documents are in each bucket; at most one row a bucket and task is shuffled."""

    def work(batches):
        total = None
        for batch in batches:
            for x in batch.column(0):
                one = np.frombuffer(x.as_py(), np.int64)
                total = one if total is None else total + one
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return found.where("counts is not null").select("counts").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: how much likelier it is under the target, in thousandths of a nat, rounded down."""
    both = bucket_counts(corpus).withColumn("side", F.lit(0)).unionByName(bucket_counts(target).withColumn("side", F.lit(1)))
    n = np.zeros((2, buckets), np.int64)
    for r in both.collect():  # a row for each bucket at most
        n[r.side, r.bucket] = r.n
    s, t = (x.tolist() for x in n)
    all_s, all_t = sum(s), sum(t)
    return np.array([math.floor(1000 * math.log(float((b + 1) * (all_s + buckets)) / float((a + 1) * (all_t + buckets)))) for a, b in zip(s, t, strict=True)], np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """One row per document of ``features``: its id, n_words, n_features, weight."""
    schema = T.StructType([found.schema[0], *(T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight"))])

    def work(batches):
        for batch in batches:
            for a, b in W.row_slices(batch.column(2), SLICE_BYTES):
                part = batch.slice(a, b - a)
                data, off = W.column_bytes(part.column(2))
                upto = np.concatenate([[0], np.cumsum(gain[data.view(np.uint16)])])
                off = off // 2
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(off)), pa.array(upto[off[1:]] - upto[off[:-1]])], names=schema.names)

    return found.where("n_words is not null").drop("counts").mapInArrow(work, schema)


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, target_id: str = "item_id") -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank (null: not drawn).

    A document's score is its weight and Gumbel noise from ``seed`` and its id, so the highest scores are a
    draw without replacement in proportion to the exponential of the weight.
    """
    corpus, wanted = features(docs, buckets=buckets), features(target, target_id, buckets=buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = stored(weighed(corpus, gains(corpus, wanted, buckets)).withColumn("score", F.col("weight") + noise), "scores")
    able = F.col("n_words") >= least_words
    draw = scored.where(able).count() * percent // 100
    placed = dealt_in_runs(scored, [(~able).asc(), F.col("score").desc(), F.col("doc_id").asc()], 1, "run", "slot")
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(able & (F.col("slot") < draw), F.col("slot") + 1).alias("rank"))


#: The same in DuckDB; the checksum is folded byte by byte over a table made by the first query.
ORACLE_SQL = r"""
with recursive steps as (select i, 0 as n, i::ubigint as c from range(256) t(i) union all select i, n + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where n < 8),
crcs as (select list(c order by i) as tab from steps where n = 8),
both_texts as (select 0 as side, row_number() over () as r, doc_id, text from documents union all select 1, row_number() over (), null, text from benchmark),
words as (select side, r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from both_texts),
grams as (select side, r, unnest(w) as g from words
 union all select side, r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from words
 union all select side, r, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from words),
hashed as (select g, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, octet_length(encode(g)) * 2, 2), lambda j: cast('0x' || substr(hex(encode(g)), j, 2) as ubigint))), lambda c, b: xor(c >> 8, tab[cast(xor(c, b) & 255 as int) + 1])), 4294967295) % 10000 as bucket
 from (select distinct g from grams), crcs),
placed as (select side, r, bucket from grams join hashed using (g)),
counts as (select bucket, sum((side = 0)::int)::bigint as s, sum((side = 1)::int)::bigint as t from placed group by bucket),
sums as (select sum(s)::bigint as all_s, sum(t)::bigint as all_t from counts),
gains as (select bucket, cast(floor(1000 * ln(((t + 1) * (all_s + 10000))::double / ((s + 1) * (all_t + 10000))::double)) as bigint) as gain from counts, sums),
weights as (select r, count(*) as n_features, sum(gain)::bigint as weight from placed join gains using (bucket) where side = 0 group by r),
scored as (select doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight, coalesce(len(w), 0) as n_words,
 coalesce(weight, 0)::bigint + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
 from words left join weights using (r) where side = 0),
drawn as (select *, row_number() over (order by n_words < 20, score desc, doc_id) as place, floor(5 * sum((n_words >= 20)::int) over () / 100) as draw from scored)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= draw then place end as rank from drawn
"""
