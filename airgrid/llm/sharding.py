"""Shards cut from a Hilbert curve over several metadata dimensions.

Language, source and size are quantised by their quantiles, in an order that keeps the
columns' own order, so that neighbours on the curve have near values in every dimension and
the minima and maxima of a shard's files prune well for any of them.  Rows are sorted by
curve index (range partitions, ties split by size, digest, id and place), counted, and cut
into runs: shards differ by at most one row, and a slot is the rank within its run.

Equal texts are one group: all stand on the curve where the group's first (language, source)
stands, so that they follow each other.  A group is in one shard, or in shards that follow
each other where its rows lie across a cut or are more than a shard holds.

Defined cases: nulls come before all values; a null text has size 8 and the CRC of no bytes,
and is in the group of empty texts; repeated rows and ties are dealt like others; very long
texts are rows like others; columns of any name are kept as they are; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, join_by_share, stored

SHARDS = 24
#: Levels of each dimension, as a power of two.
BITS = 5


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points (rows; one column for each dimension, values under 2**bits).

    Undoes the rotations from the highest bit down, then Gray-codes, then interleaves.
    """
    x = axes.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def number_cuts(df: DataFrame, column: str, cuts: int) -> list:
    """Approximate quantiles at 1 / cuts, 2 / cuts and so on, each once."""
    shares = [i / cuts for i in range(1, cuts)]
    return sorted(set(df.agg(F.percentile_approx(column, F.array(*map(F.lit, shares)), 1000).alias("q")).first().q or []))


def text_cuts(df: DataFrame, column: str, cuts: int) -> list[str]:
    """The same for strings, exactly: distinct values are counted, sorted over partitions and summed; only the cuts reach the driver."""
    values = stored(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).repartitionByRange("v").withColumn("run", F.spark_partition_id()), "values")
    runs = values.groupBy("run").agg(F.sum("n").alias("all"))  # one row for each partition
    runs = runs.withColumn("before", F.coalesce(F.sum("all").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = values.agg(F.sum("n")).first()[0] or 0
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("run").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    step = lambda x: F.floor(x * cuts / F.lit(max(total, 1)))
    placed = values.join(F.broadcast(runs), "run").withColumn("upto", upto)
    return [r.v for r in placed.where((step(F.col("upto")) > step(F.col("upto") - F.col("n"))) & (F.col("upto") < total)).select("v").orderBy("v").collect()]


def level(column: Column, cuts: list) -> Column:
    """How many cuts a value is above; null is above none.  Equal values have equal levels."""
    return sum((F.coalesce((column > F.lit(c)).cast("int"), F.lit(0)) for c in cuts), F.lit(0))


def hilbert(levels: list, bits: int = BITS):
    """Column of curve indexes."""

    @F.pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], 1), bits))

    return index(*levels)


def dealt_in_runs(df: DataFrame, keys: list, shards: int, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``df`` with ``shard`` and ``slot``: its rows in the order of ``keys``, cut into runs whose counts differ by one at most."""
    run, at, total, before = (fresh(df.columns, x) for x in ("_run", "_at", "_total", "_before"))
    tie = fresh(df.columns, "_tie")
    # equal keys are still split over partitions, by where they stood
    ranged = df.withColumn(tie, F.monotonically_increasing_id())
    order = [*keys, F.col(tie)]
    placed = stored(
        ranged.repartitionByRange(*order).sortWithinPartitions(*order).drop(tie)
        .withColumn(run, F.spark_partition_id())
        .withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "sharding",
    )
    # one row for each partition
    counts = placed.groupBy(run).agg(F.count("*").alias(total))
    counts = counts.select(run, F.coalesce(F.sum(total).over(Window.orderBy(run).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    n = placed.count()
    small, more = divmod(n, shards)
    edge = more * (small + 1)
    rank = F.col(before) + F.col(at)
    which = F.when(rank < edge, F.floor(rank / F.lit(small + 1))).otherwise(more + F.floor((rank - edge) / F.lit(max(1, small)))).cast("int")
    where = F.when(rank < edge, rank % F.lit(small + 1)).otherwise((rank - edge) % F.lit(max(1, small))).cast("long")
    return placed.join(F.broadcast(counts), run).withColumn(shard, which).withColumn(slot, where).drop(run, at, before)


def on_curve(base: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """``base`` with a struct column ``key`` (lang, source, size, digest) and a column <key>_index: the curve index of the row's group of equal texts."""
    shared = base.groupBy(F.col(f"{key}.digest").alias(f"{key}_digest")).agg(F.count("*").alias("n"), F.min(F.struct(f"{key}.lang", f"{key}.source")).alias(f"{key}_first")).where("n > 1")
    first, digest = f"{key}_first", f"{key}_digest"
    grouped = join_by_share(base.withColumn(digest, F.col(f"{key}.digest")), stored(shared, "equal-texts"), digest, "n", base.count()).drop(digest)
    own = F.struct(F.col(f"{key}.lang"), F.col(f"{key}.source"))
    grouped = grouped.withColumn(first, F.coalesce(first, own))
    cuts = 1 << bits
    levels = [level(F.col(f"{first}.{c}"), text_cuts(base.select(F.col(f"{key}.{c}").alias("v")), "v", cuts)) for c in ("lang", "source")]
    levels.append(level(F.col(f"{key}.size"), number_cuts(base.select(F.col(f"{key}.size").alias("v")), "v", cuts)))
    return grouped.withColumn(f"{key}_index", hilbert(levels, bits)).drop(first)


def _key() -> Column:
    return F.struct(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


def _order(key: str) -> list[Column]:
    return [F.col(f"{key}_index"), F.col(f"{key}.size"), F.col(f"{key}.digest"), F.col("doc_id")]


def shard_documents(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert_index."""
    base = docs.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), _key().alias("key"))
    out = dealt_in_runs(on_curve(stored(base, "shard-keys"), "key", bits), _order("key"), shards)
    return out.select("doc_id", F.col("key.size").alias("size"), "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("key_index").alias("hilbert_index"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, bits: int = BITS) -> str:
    """The documents as Parquet, one folder for each shard, in the order and shards of ``shard_documents``.

    A shard's files follow each other in slot order, one for each range partition that it lies in, so no
    task has a whole shard.  Returns the name of the folders' column: shard, or a like one that the documents do not have.
    """
    key, shard, slot = fresh(docs.columns, "_key"), fresh(docs.columns, "shard"), fresh(docs.columns, "slot")
    placed = dealt_in_runs(on_curve(stored(docs.withColumn(key, _key()), "shard-rows"), key, bits), _order(key), shards, shard, slot)
    placed.sortWithinPartitions(shard, slot).drop(key, f"{key}_index", slot).write.partitionBy(shard).parquet(path)
    return shard
