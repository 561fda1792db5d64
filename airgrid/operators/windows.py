"""Window logic over ordered listings; each needs a column of order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def rollover(rows: DataFrame, keys: list[str], order: str, minute: str) -> DataFrame:
    """day_offset: one more whenever the clock goes back within a key's listing."""
    w = Window.partitionBy(*keys).orderBy(order)
    back = (F.col(minute) < F.lag(minute).over(w)).cast("int")
    return rows.withColumn("_back", F.coalesce(back, F.lit(0))).withColumn("day_offset", F.sum("_back").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_back")


def next_end(rows: DataFrame, keys: list[str], order: list[str], start: str) -> DataFrame:
    """next_start: when the next programme begins; null for the last.  Over all programmes, before any filter."""
    return rows.withColumn("next_start", F.lead(start).over(Window.partitionBy(*keys).orderBy(*order)))


def day_blocks(rows: DataFrame, keys: list[str], order: str, minute: str, opening: Column) -> DataFrame:
    """block: from 0; a block begins with the opening, or when the clock passes six in the morning."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(minute).over(w)
    begins = before.isNotNull() & (((F.col(minute) == 420) & opening) | ((before <= 359) & (F.col(minute) >= 360)))
    return rows.withColumn("_new", begins.cast("int")).withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def repeats(rows: DataFrame, order: list[str]) -> DataFrame:
    """repeated: the same text was on the same channel before."""
    folded = F.lower(text.collapsed(F.col("title")))
    return rows.withColumn("repeated", F.row_number().over(Window.partitionBy("channel", folded).orderBy(*order)) > 1)


def filled(rows: DataFrame, keys: list[str], order: str, column: str, name: str) -> DataFrame:
    """``name``: the last value of ``column`` that is not null, up to the row."""
    return rows.withColumn(name, F.last(column, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def budgeted(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key; Spark keeps n rows a key in each task before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
