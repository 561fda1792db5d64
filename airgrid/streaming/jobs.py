"""Streams over landed observations; each is a batch of the same rows when it is done."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text
from ..operators import ordered
from ..sources.shared import settled

CONFIRMATIONS = 2


def landed(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A stream of the Parquet files of one table in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def status_counts(events: DataFrame) -> DataFrame:
    """Counts by type, updated as files come."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, late: str = "1 day", size: str = "1 hour") -> DataFrame:
    """Counts by hour and type; rows later than ``late`` after the newest are dropped and closed hours leave the state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")


def settle(state: tuple | None, seen: str, need: int = CONFIRMATIONS) -> tuple[tuple, bool]:
    """The state (stable, candidate, times) after one more observation, and whether it is served.

    What is stable is served; something else must be seen ``need`` times in a row to take its place.
    """
    if state is None:
        return (seen, "", 0), True
    stable, candidate, times = state
    if seen == stable:
        return (stable, "", 0), True
    times = times + 1 if seen == candidate else 1
    return ((seen, "", 0), True) if times >= need else ((stable, seen, times), False)


def _newest_below(spark: SparkSession, folder: str, schema: str, column: str, i: int) -> DataFrame | None:
    """What the newest batch (or version) below ``i`` has left in a folder, or nothing."""
    newest = spark.read.schema(f"{schema}, {column} long").parquet(folder).where(F.col(column) < i).agg(F.max(column)).first()[0]
    return None if newest is None else spark.read.schema(schema).parquet(f"{folder}/{column}={newest}")


class _Source:
    """What is known of one source while its observations are walked."""

    def __init__(self, source: str):
        self.source, self.state = source, None

    def step(self, kind: int, ord_: int, seen: str, stable: str, candidate: str, times: int):
        if kind == 0:
            self.state = (stable, candidate, times)
        else:
            self.state, served = settle(self.state, seen)
            yield self.source, 1, ord_, self.state[0], "", 0, served

    def end(self):
        yield self.source, 0, None, *self.state, None


def debounced(observations: DataFrame, folder: str) -> DataFrame:
    """source, ord, stable, served for each observation (source, ord, signature) of a stream, once it is done with all that has landed.

    A batch's observations are sorted by source and order by Spark and walked after what the batches before have left
    of each source, so a task holds one Arrow batch and one state whatever a source sends.  A batch writes its rows and the states
    after it in one go under its own number; a batch that is run again after a restart starts from the same states.
    """
    spark = observations.sparkSession
    state = "source string, kind int, ord long, stable string, candidate string, times int, served boolean"
    out = f"{folder}/batches"
    spark.createDataFrame([], state).write.mode("ignore").parquet(f"{out}/batch=-1")

    def step(batch: DataFrame, i: int) -> None:
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("stable", "string"), ("candidate", "string"), ("times", "int"))]
        rows = batch.select("source", F.lit(1).alias("kind"), F.col("ord").cast("long").alias("ord"), "signature", *empty)
        if (before := _newest_below(spark, out, state, "batch", i)) is not None:
            rows = rows.unionByName(before.where("kind = 0").select("source", "kind", "ord", F.lit(None).cast("string").alias("signature"), "stable", "candidate", "times"))
        walked = ordered.walked(rows, ["source"], ["kind", "ord"], ["kind", "ord", "signature", "stable", "candidate", "times"], state, _Source, _Source.step, _Source.end)
        walked.write.mode("overwrite").parquet(f"{out}/batch={i}")

    observations.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{state}, batch long").parquet(out).where("kind = 1").select("source", "ord", "stable", "served")


def _flagged(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Of each load the row that comes first is held back until the end of the batch; all others are repeats."""
    known = state.get[0] if state.exists else None
    first: dict[int, tuple] = {}
    columns = ["load", "place", "ord", "repeated"]
    for rows in batches:
        out = []
        for load, place, ord_ in zip(rows["load"], rows["place"], rows["ord"], strict=True):
            row = (place, ord_)
            if known is not None and load <= known:
                out.append((load, *row, True))
            elif load not in first:
                first[load] = row
            else:
                out.append((load, *max(row, first[load]), True))
                first[load] = min(row, first[load])
        yield pd.DataFrame(out, columns=columns)
    if first:
        state.update((max(first),))
    yield pd.DataFrame([(load, *row, False) for load, row in first.items()], columns=columns)


def replay_flags(listings: DataFrame) -> DataFrame:
    """load, place, ord, repeated for each listing of a stream (load, place, ord, channel, title): whether its load has had the same text on the same channel before.

    Repeats are told, not dropped; each load begins anew.  The state of a channel and text is the last load that had it.  Loads land
    one after the other; in a load, rows are in order of ``place``.  What lands after a later load has been seen counts as a repeat.
    """
    keyed = listings.withColumn("folded", F.lower(text.collapsed(F.col("title"))))
    return keyed.groupBy("channel", "folded").applyInPandasWithState(_flagged, "load long, place string, ord long, repeated boolean", "load long", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that has landed and read back what it wrote; ``folder`` keeps its checkpoint and its rows.

    Complete and update results are written by micro-batch, the last one standing.
    """
    spark = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    else:
        write = lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/rows")
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def refresh(versions: DataFrame, folder: str, diff, systemic=None) -> DataFrame:
    """Snapshots that come one after another, each compared with the one before it.

    The first is kept silently; every later one is saved before its changes are written, so a
    restart repeats no message: a batch writes only under its own number.  ``diff``: (old, new) → changes.
    Changes that ``systemic`` (changes → one row with a column systemic) tells to be a slip of the whole
    guide are kept under ``suppressed`` instead; the snapshot is the new one all the same.
    """
    spark = versions.sparkSession
    kept = [f for f in versions.schema.fields if f.name != "version"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def step(batch: DataFrame, i: int) -> None:
        for (v,) in sorted(batch.select("version").distinct().collect()):  # as many as files in the batch
            new = batch.where(F.col("version") == v).drop("version")
            new.write.mode("overwrite").parquet(f"{folder}/snapshots/version={v}")
            if (old := _newest_below(spark, f"{folder}/snapshots", schema, "version", v)) is not None:
                found = settled(diff(old, spark.read.schema(schema).parquet(f"{folder}/snapshots/version={v}")), "changes")
                slip = systemic is not None and bool(systemic(found).first()["systemic"])
                found.write.mode("overwrite").parquet(f"{folder}/{'suppressed' if slip else 'changes'}/version={v}")

    versions.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/changes")
