"""Session settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with ``SETTINGS``; instants are stored in UTC and turned into local time at the edges."""
    builder = SparkSession.builder.appName("airgrid").config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()
