"""Dates and clocks, as column expressions; the present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L


def parsed(date: Column, time: Column) -> Column:
    """A local instant; null where either is not one.  Hours may have one digit."""
    return F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit("yyyy-MM-dd H:mm"))


def fallback_minutes(sport: Column) -> Column:
    flat = [F.lit(v) for p in L.DURATIONS.items() for v in p]
    return F.coalesce(F.try_element_at(F.create_map(*flat), F.lower(F.btrim(F.coalesce(sport, F.lit(""))))), F.lit(L.DEFAULT_DURATION))


def minutes(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"), F.lit(0))


def bounds(start: Column, slot_end: Column, sport: Column) -> Column:
    """start, end, method: the slot's own end, a day later if not after the start, else the sport's usual length."""
    rolled = F.when(slot_end <= start, slot_end + F.expr("interval 1 day")).otherwise(slot_end)
    end = F.coalesce(rolled, start + minutes(fallback_minutes(sport)))
    return F.struct(start.alias("start"), end.alias("end"), F.when(slot_end.isNull(), "duration").otherwise("slot").alias("method"))


def status(start: Column, end: Column, now: str) -> Column:
    """The start is in the broadcast, the end is not."""
    at = F.lit(now).cast("timestamp")
    return F.when(at < start, "upcoming").when(at < end, "live").otherwise("finished")


def local(instant: Column, zone: str = L.ZONE) -> Column:
    return F.from_utc_timestamp(instant, zone)


def minute_of_day(time: Column) -> Column:
    return F.substring(time, 1, 2).cast("int") * 60 + F.substring(time, 4, 2).cast("int")


def window_text(start: Column, end: Column) -> Column:
    """Both clocks, with dates where the days differ."""
    months = F.array(*map(F.lit, L.MONTHS))
    clock = lambda x: F.date_format(x, "HH:mm")
    dated = lambda x: F.concat(F.dayofmonth(x).cast("string"), F.lit(" "), F.element_at(months, F.month(x)), F.lit(" "), clock(x))
    return F.when(F.to_date(start) == F.to_date(end), F.concat(clock(start), F.lit("–"), clock(end))).otherwise(F.concat(dated(start), F.lit(" – "), dated(end)))


def hour(h: Column, m: Column, half: Column) -> Column:
    """Minute of the day of a clock with or without am/pm; null where it is none."""
    half = F.lower(F.coalesce(half, F.lit("")))
    good_m = m.between(0, 59)
    twelve = F.when(half.startswith("p"), F.when(h == 12, 12).otherwise(h + 12)).otherwise(F.when(h == 12, 0).otherwise(h))
    return F.when(good_m & (half != "") & h.between(1, 12), twelve * 60 + m).when(good_m & (half == "") & h.between(0, 23), h * 60 + m)


def aligned(base_date: Column, clock_minutes: Column, hours_east: Column, event_date: Column, zone: str = L.ZONE) -> Column:
    """The local instant of a bare clock of another zone: of the day before, the day and the day after, that whose
    local date is nearest to the event's, the smaller shift first among equals."""

    def candidate(shift: Column) -> Column:
        utc = F.date_add(base_date, shift).cast("timestamp") + minutes(clock_minutes - hours_east * 60)
        at = F.from_utc_timestamp(utc, zone)
        return F.struct(F.abs(F.date_diff(F.to_date(at), event_date)).alias("days"), F.abs(shift).alias("far"), shift.alias("shift"), at.alias("at"))

    return F.array_min(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), candidate))["at"]


def aligned_in(day: Column, clock_minutes: Column, source_zone: Column, zone: str = L.ZONE) -> Column:
    """As ``aligned``, for a clock of a zone by name, with that zone's summer time."""

    def candidate(shift: Column) -> Column:
        at = F.from_utc_timestamp(F.to_utc_timestamp(F.date_add(day, shift).cast("timestamp") + minutes(clock_minutes), source_zone), zone)
        return F.struct(F.abs(F.date_diff(F.to_date(at), day)).alias("days"), F.abs(shift).alias("far"), shift.alias("shift"), at.alias("at"))

    return F.array_min(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), candidate))["at"]


def week_key(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day))


def near_year(day: Column, month: Column, anchor: Column) -> Column:
    """The date of a day and month in the year that brings it within half a year of the anchor."""
    options = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.try_make_date(F.year(anchor) + k, month, day) if hasattr(F, "try_make_date") else F.to_date(F.try_to_timestamp(F.concat_ws("-", (F.year(anchor) + k).cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), F.lit("yyyy-MM-dd"))))
    dated = F.transform(F.filter(options, lambda x: x.isNotNull()), lambda x: F.struct(F.abs(F.date_diff(x, anchor)).alias("far"), x.alias("date")))
    best = F.array_min(dated)
    return F.when(best["far"] <= 180, best["date"])
