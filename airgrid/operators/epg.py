"""Rows of a provider's listing: it says what a channel plans, never that an event takes place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock, lexicon, text

SPLIT = r"(?i)\s-\s|[–—]|\s(?:vs\.?|v\.)\s"
MARKS = " .,-–—"


def inferred(title: Column, tournament: Column) -> Column:
    """tournament, title: where no tournament is given, what stands before the last dot is it, if a match follows."""
    t = text.collapsed(title)
    parts = F.filter(F.transform(F.split(t, r"\. "), lambda x: F.btrim(x, F.lit(MARKS))), lambda x: x != "")
    tail = F.try_element_at(parts, F.lit(-1))
    before = F.btrim(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), ". "), F.lit(MARKS))
    found = (F.btrim(F.coalesce(tournament, F.lit(""))) == "") & (F.size(parts) >= 2) & tail.rlike(SPLIT)
    return F.when(found, F.struct(before.alias("tournament"), tail.alias("title"))).otherwise(F.struct(F.coalesce(tournament, F.lit("")).alias("tournament"), F.coalesce(title, F.lit("")).alias("title")))


def localised(rows: DataFrame, zone: str = lexicon.ZONE) -> DataFrame:
    """Rows whose clocks (start_at, end_at) are the provider's UTC, in local time, with where they came from."""
    source = F.date_format("start_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    at = rows.withColumns({"source_start": source, "start_at": clock.local(F.col("start_at"), zone), "end_at": clock.local(F.col("end_at"), zone)})
    return at.withColumns({"date": F.date_format("start_at", "yyyy-MM-dd"), "time": F.date_format("start_at", "HH:mm"), "offset": F.hour("start_at") * 60 + F.minute("start_at")})


def classified(rows: DataFrame) -> DataFrame:
    """``rows`` (ord, channel, date, raw_title, title, tournament, sport, claimed) with sport, tournament and title inferred, and state, method, is_sport_event.

    A repeat by its words, then by a year that is not the date's, then by a listing of the same channel and text
    before it, is not live; all else is unknown until an event confirms it.
    """
    said = F.lower(F.concat_ws(" ", F.coalesce("raw_title", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("tournament", F.lit(""))))
    r = rows.withColumn("sport", F.when(F.btrim(F.coalesce("sport", F.lit(""))) == "", text.sport_hint(said)).otherwise(F.col("sport")))
    r = r.withColumn("_split", inferred(F.col("title"), F.col("tournament"))).withColumns({"tournament": F.col("_split.tournament"), "title": F.col("_split.title")}).drop("_split")
    said = F.lower(F.concat_ws(" ", F.coalesce("raw_title", F.lit("")), "title", "tournament"))
    r = r.withColumn("_said", said)
    first = r.groupBy("channel", text.collapsed(F.col("_said")).alias("_key")).agg(F.min(F.struct("date", "ord")).alias("_first"))
    r = r.withColumn("_key", text.collapsed(F.col("_said"))).join(first, ["channel", "_key"])
    repeated = F.struct("date", "ord") != F.col("_first")
    years = F.regexp_extract_all("_said", F.lit(r"(?<!\d)(20\d\d)(?!\d)"), F.lit(1))
    stale = (F.size(years) > 0) & ~F.array_contains(years, F.substring("date", 1, 4))
    replay = text.contains_any(F.col("_said"), lexicon.EPG_REPLAY)
    event = F.col("_said").rlike(SPLIT) | text.contains_any(F.col("_said"), lexicon.EPG_EVENT)
    method = F.when(replay, "provider_replay_or_editorial").when(stale, "provider_stale_year").when(repeated, "provider_repeat_epg").when(F.col("claimed"), "provider_live_unverified").when(event, "provider_epg_sport_candidate").otherwise("provider_epg_only")
    over = replay | stale | repeated
    out = r.withColumns({"method": method, "live_state": F.when(over, "not_live").otherwise("unknown"), "state": F.when(over, "replay").otherwise("unverified"), "is_sport_event": event & ~over})
    return out.drop("_said", "_key", "_first")


def with_schedule(channels: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Channels with the schedule id of their provider, and an error row for each that has none."""
    known = channels.join(ids, ["base", "channel"])
    missing = channels.join(ids, ["base", "channel"], "left_anti").select("base", "channel", F.concat(F.lit("no schedule id: "), "channel").alias("error"))
    return known, missing


def fetched(scopes: DataFrame, payloads: DataFrame, is_good: Column) -> tuple[DataFrame, DataFrame]:
    """Of channel and date scopes, the payloads that can be read and an error row for each other; one bad payload stops no other."""
    got = scopes.join(payloads, ["channel", "date"], "left")
    good = F.coalesce(is_good, F.lit(False))
    return got.where(good), got.where(~good).select("channel", "date", F.when(F.col("body").isNull(), "no payload").otherwise("unreadable payload").alias("error"))
