"""Small helpers shared by the operators: tables, shared folders, sizes, names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only when its stored rows are at most this many.
BROADCAST_ROWS = 20_000
#: Or when its key has more than this share of all rows, so at most so many have.
HOT_SHARE = 1 / 5_000
#: And only when the strings in them have at most this many bytes.
BROADCAST_BYTES = 8 << 20
#: Bytes of an Arrow batch on its way to Python.
ARROW_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    Only where that setting is missing (tests on one machine) the folder that the
    session already uses, or one under the warehouse, is taken instead.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir is None:
        set_dir = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return set_dir.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ``ARROW_BYTES`` meanwhile: texts are long, and both sides hold a batch or two a task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, f"{ARROW_BYTES}b")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without running what
    came before again, and reads the same rows each time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(taken, base: str) -> str:
    """A column name that is not in ``taken`` (compared without case)."""
    low = {c.lower() for c in taken}
    name, i = base, 0
    while name.lower() in low:
        i += 1
        name = f"{base}_{i}"
    return name


def named(columns) -> list[Column]:
    """Columns by their very names, whatever signs are in them."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def small_or_join(left: DataFrame, right: DataFrame, on, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a stored ``right``; it is broadcast only if its counted rows and the bytes of its strings fit."""
    wide = [F.octet_length(f.name) for f in right.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    if any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in right.schema.fields):
        raise ValueError("nested columns have no counted size")
    size = right.agg(F.count("*").alias("n"), F.coalesce(F.sum(sum(wide, F.lit(0))), F.lit(0)).alias("bytes") if wide else F.lit(0).alias("bytes")).first()
    return left.join(F.broadcast(right) if size.n <= limit and size.bytes <= BROADCAST_BYTES else right, on, how)


def join_by_share(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "left") -> DataFrame:
    """Join with a stored ``right`` that has one row a ``key`` and tells in ``weight`` how many of the ``total`` rows of ``left`` have it.

    Few rows are broadcast.  Of many, those with more than ``HOT_SHARE`` of all rows are (there are at
    most 1 / HOT_SHARE of them), and only the rows of the others are shuffled.  ``how``: left or inner.
    """
    slim = right.drop(weight)
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(slim), key, how)
    hot, cold = (right.where(c).drop(weight) for c in (F.col(weight) > total * HOT_SHARE, F.col(weight) <= total * HOT_SHARE))
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return left.join(F.broadcast(hot), key).unionByName(rest)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is bound to a lambda variable and so is computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
