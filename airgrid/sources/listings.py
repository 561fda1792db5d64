"""Live icons in a third party's pages of a week or a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text
from ..operators.schedule import first_by
from . import html

#: The icon, the words of a direct broadcast, and a day's heading.
ICON = r"(?i)(^|/)ico_live\.gif($|[?#])"
DIRECT = r"(?iu)(?<![\p{L}\d])прямая\s+трансляция(?![\p{L}\d])"
HEADING = r"(?iu)(\d{1,2})\s+(" + "|".join(L.MONTHS) + ")"
REACH = 250


def heading_date(said: Column, anchor: Column) -> Column:
    """The day and month of a heading in the anchor's year, or in the year before or after if that is more than half a year away."""
    day, name = F.regexp_extract(said, HEADING, 1).try_cast("int"), F.lower(F.regexp_extract(said, HEADING, 2))
    month = F.array_position(F.array(*map(F.lit, L.MONTHS)), name).cast("int")
    dated = lambda year: F.to_date(F.try_to_timestamp(F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string")), F.lit("yyyy-M-d")))
    here = dated(F.year(anchor))
    far = F.date_diff(here, anchor)
    return F.when(name != "", F.when(far > 180, dated(F.year(anchor) - 1)).when(far < -180, dated(F.year(anchor) + 1)).otherwise(here))


def has_class(name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit("")), r"\s+"), name)


def live_rows(pages: DataFrame, key: str, markup: str, anchor: Column, week: bool = True) -> DataFrame:
    """key, date, time, title, explicit (it says so in words) of every programme with the live icon; of equal ones the first.

    A programme's clock is in the cell before it, or else in the first of its row; its date is the last heading of a
    day before it, not further than ``REACH`` texts.  ``week`` false: the page is of the anchor's day and has no headings.
    """
    every = html.elements(pages, key, markup)
    is_cell, is_time = (F.col("tag") == "div") & has_class("prname2"), (F.col("tag") == "div") & has_class("time")
    is_icon = (F.col("tag") == "img") & F.coalesce(F.try_element_at("attrs", F.lit("src")).rlike(ICON), F.lit(False))
    clock = F.regexp_extract("text", r"(?<![\p{L}\d])([0-2]?\d:[0-5]\d)(?![\p{L}\d])", 1)
    told = every.select(key, "ord", "parent", "last", is_icon.alias("is_icon"), F.when(is_cell, text.collapsed(F.col("text"))).alias("title"), F.when(is_time, clock).alias("clock"))
    times = (F.col("clock").isNotNull(), F.struct("ord", "clock"))
    told = html.following(told, key, icon=(F.col("is_icon"), F.col("ord")), first=times)
    before = Window.partitionBy(key, "parent").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    cells = told.where("parent >= 0 and (title is not null or clock is not null)").withColumn("own", F.last(F.when(*times), ignorenulls=True).over(before))
    live = cells.where("title is not null and icon <= last").select(key, "ord", "parent", "title", "own")
    parents = told.where("first.ord <= last").select(key, F.col("ord").alias("parent"), "first")
    rows = live.join(parents, [key, "parent"]).select(key, "ord", "title", F.coalesce("own.clock", "first.clock").alias("clock")).where("clock <> '' and title <> ''")
    rows = rows.join(pages.select(key, anchor.alias("anchor")), key)
    if week:
        nodes = html.placed_nodes(pages, key, markup).join(pages.select(key, anchor.alias("anchor")), key)
        marks = nodes.select(key, F.col("after").alias("pos"), F.lit(0).alias("kind"), "node", F.when(heading_date(F.col("text"), F.col("anchor")).isNotNull(), F.struct("node", heading_date(F.col("text"), F.col("anchor")).alias("date"))).alias("head"), F.lit(None).cast("int").alias("ord"))
        wanted = rows.select(key, F.col("ord").alias("pos"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("node"), F.lit(None).cast("struct<node:int,date:date>").alias("head"), "ord")
        w = Window.partitionBy(key).orderBy("pos", "kind", "node").rowsBetween(Window.unboundedPreceding, 0)
        told = marks.unionByName(wanted).withColumns({"h": F.last("head", ignorenulls=True).over(w), "n": F.last("node", ignorenulls=True).over(w)}).where("kind = 1")
        rows = rows.join(told.where(F.col("n") - F.col("h.node") < REACH).select(key, "ord", F.col("h.date").alias("date")), [key, "ord"])
    else:
        rows = rows.withColumn("date", F.col("anchor"))
    out = rows.select("ord", key, F.date_format("date", "yyyy-MM-dd").alias("date"), F.lpad("clock", 5, "0").alias("time"), "title", F.col("title").rlike(DIRECT).alias("explicit"))
    return first_by(out, [F.col(key), F.col("date"), F.col("time"), F.lower("title")], ["ord"]).drop("ord")
