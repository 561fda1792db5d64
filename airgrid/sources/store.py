"""Snapshots and logs as Parquet tables: versions are appended, never changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.schedule import first_by


def upserted(stored: DataFrame, batch: DataFrame, run: str, at: str) -> DataFrame:
    """The scopes of ``batch`` after it: storage_id, source, scope_date, first_seen, last_seen, run, active.

    Rows seen again keep their first sight, rows no longer seen stay but are not active; of
    equal ids in a batch the last wins.
    """
    new = batch.withColumn("_last", -F.col("ord"))
    new = first_by(new, [F.col("storage_id")], ["_last"]).drop("_last").select("storage_id", F.col("source").alias("n_source"), F.col("scope_date").alias("n_scope"))
    old = stored.select("storage_id", "source", "scope_date", "first_seen", "last_seen", "run")
    j = old.join(new, "storage_id", "full")
    seen = F.col("n_source").isNotNull()
    return j.select(
        "storage_id",
        F.coalesce("n_source", "source").alias("source"),
        F.coalesce("n_scope", "scope_date").alias("scope_date"),
        F.coalesce("first_seen", F.lit(at)).alias("first_seen"),
        F.when(seen, F.lit(at)).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(seen, F.lit(run)).otherwise(F.col("run")).alias("run"),
        seen.alias("active"),
    )


def append(df: DataFrame, path: str, version: int) -> None:
    """One more version of a table."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version; older ones are pruned as partitions."""
    every = spark.read.parquet(path)
    newest = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == newest).drop("version")


def published(fresh: DataFrame, stored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows to serve: a scope's new rows if its verdict allows, else the last good ones.

    ``verdicts``: source, scope_date, status; ok and warning are published.
    """
    good = verdicts.where(F.col("status").isin("ok", "warning")).select("source", "scope_date")
    bad = verdicts.where(~F.col("status").isin("ok", "warning")).select("source", "scope_date")
    key = ["source", "scope_date"]
    return fresh.join(good, key, "left_semi").withColumn("fallback", F.lit(False)).unionByName(stored.join(bad, key, "left_semi").withColumn("fallback", F.lit(True)))


def active_counts(stored: DataFrame) -> DataFrame:
    return stored.where("active").groupBy("source", "scope_date").agg(F.count("*").alias("n"))


def state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small JSON state; broken records give nulls and do not stop the read."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
