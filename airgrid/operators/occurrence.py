"""When an event takes place, by pages that were found about it.

Built-in expressions give matches of a pattern but not where they stand, and a clock belongs to
the nearest date.  So each different text goes through Arrow batches once, which tell its dates and
clocks; all that follows is relational.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import settled
from . import texts, verify
from .reconcile import EARLIEST, LATEST, minutes_between

# Months by name, cue words, zones by the letters after a clock, and which of them want am or pm.
MONTH_NAMES = {
    "january": 1, "jan": 1, "января": 1, "январь": 1,
    "february": 2, "feb": 2, "февраля": 2, "февраль": 2,
    "march": 3, "mar": 3, "марта": 3, "март": 3,
    "april": 4, "apr": 4, "апреля": 4, "апрель": 4,
    "may": 5, "мая": 5, "май": 5,
    "june": 6, "jun": 6, "июня": 6, "июнь": 6,
    "july": 7, "jul": 7, "июля": 7, "июль": 7,
    "august": 8, "aug": 8, "августа": 8, "август": 8,
    "september": 9, "sep": 9, "sept": 9, "сентября": 9, "сентябрь": 9,
    "october": 10, "oct": 10, "октября": 10, "октябрь": 10,
    "november": 11, "nov": 11, "ноября": 11, "ноябрь": 11,
    "december": 12, "dec": 12, "декабря": 12, "декабрь": 12,
}
CUES = re.compile(r"kick[\s-]?off|start(?:s|ing)?|begins?|main card|prelims|начал[оа]?|старт|начн[её]тся|время|эфир", re.I)
CUE_REACH = 100
CONFIRM_MINUTES = 30
ZONES = {
    "utc": "UTC", "gmt": "UTC", "msk": "Europe/Moscow", "мск": "Europe/Moscow", "edt": "America/New_York", "et": "America/New_York", "est": -5,
    "pdt": "America/Los_Angeles", "pt": "America/Los_Angeles", "pst": -8, "cest": 2, "cet": 1,
}
HALF_DAY_ZONES = ("edt", "et", "est", "pdt", "pt", "pst")
FULL_DAY_ZONES = ("cest", "cet")

_WORD = re.compile(r"\b([^\W\d_]{3,9})\b")  # a month's name is one of these; a look into the table is quicker than trying all names everywhere
_NUMBERS = re.compile(r"(?<!\d)(?=(\d{1,4})([-./])(\d\d?)([-./])(\d{1,4})(?!\d))")
_DAY_AFTER = re.compile(r"\s+(\d\d?)(?:st|nd|rd|th)?,?\s+(20\d\d)\b", re.I)
_DAY_BEFORE = re.compile(r"\b(\d\d?)\s+$")
_YEAR_AFTER = re.compile(r",?\s+(20\d\d)\b")
_CLOCK = re.compile(r"(?<!\d)(?P<h>\d\d?)(?::(?P<m>\d\d))?\s*(?P<half>am|pm)?(?:(?!\w)|(?=(?:utc|gmt|msk|мск|edt|est|et|pdt|pst|pt|cest|cet)\b))", re.I)
_ZONE = re.compile(rf"\s*({'|'.join(sorted(ZONES, key=len, reverse=True))})\b", re.I)


def _stated(said: str) -> Iterator[tuple[int, int, int, int]]:
    """Year, month, day and place of everything that has the form of a date."""
    for m in _NUMBERS.finditer(said):
        a, one, b, two, c = m.groups()
        if len(a) == 4 and a.startswith("20") and one == two == "-" and len(c) <= 2:
            yield int(a), int(b), int(c), m.start()
        elif len(a) <= 2 and len(c) == 4 and c.startswith("20") and "-" not in (one, two):
            yield int(c), int(b), int(a), m.start()
    for m in _WORD.finditer(said):
        month = MONTH_NAMES.get(m[1].lower())
        if month is None:
            continue
        if after := _DAY_AFTER.match(said, m.end()):
            yield int(after[2]), month, int(after[1]), m.start()
        before, year = _DAY_BEFORE.search(said, max(0, m.start() - 40), m.start()), _YEAR_AFTER.match(said, m.end())
        if before and year:
            yield int(year[1]), month, int(before[1]), before.start()


def dates_in(said: str) -> list[tuple[dt.date, int]]:
    """Dates that a text states, each where it is first stated, in order of date."""
    first: dict[dt.date, int] = {}
    for year, month, day, at in _stated(said):
        try:
            date = dt.date(year, month, day)
        except ValueError:
            continue
        first[date] = min(at, first.get(date, at))
    return sorted(first.items())


def _zone_of(m: re.Match, said: str, home) -> tuple[bool, object]:
    """Whether a number is a clock, and its zone: the one stated after it, if that goes with such a clock, or else the page's own."""
    letters = _ZONE.match(said, m.end())
    if not letters:
        return home is not None and said[m.start() - 1 : m.start()] != ":", home
    name = letters[1].lower()
    fits = m["half"] if name in HALF_DAY_ZONES else m["m"] and not (m["half"] and name in FULL_DAY_ZONES)
    return bool(fits), ZONES[name]


def clocks_in(said: str, home: str | int | None, dates: list[tuple[dt.date, int]] | None = None) -> list[tuple[dt.datetime, bool, bool]]:
    """instant (UTC, no zone), zone stated, cue near, of each clock; bare numbers are clocks of the page's own zone, if that is known.

    ``home``: the page's zone, by name or in hours east.  American zones go with am or pm only, Central
    European ones without, and a clock beside a zone it does not go with is none.  A clock is of the date
    that stands nearest to it.  ``dates``: those of the text, if they are known.
    """
    dates = dates_in(said) if dates is None else dates
    out = []
    for m in _CLOCK.finditer(said) if dates else ():
        is_clock, zone = _zone_of(m, said, home)
        h, minute = int(m["h"]), int(m["m"] or 0)
        if not is_clock or minute > 59 or (m["half"] and not 1 <= h <= 12):
            continue
        if m["half"]:
            h = h % 12 + 12 * (m["half"].lower() == "pm")
        if h > 23:
            continue
        day = min(dates, key=lambda d: abs(d[1] - m.start()))[0]
        east = ZoneInfo(zone) if isinstance(zone, str) else dt.timezone(dt.timedelta(hours=zone))
        at = dt.datetime(day.year, day.month, day.day, h, minute, tzinfo=east).astimezone(dt.timezone.utc).replace(tzinfo=None)
        cue = bool(CUES.search(said, max(0, m.start() - CUE_REACH), min(len(said), m.end() + CUE_REACH)))
        out.append((at, _ZONE.match(said, m.end()) is not None, cue))
    return out


FOUND = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in {"date": T.DateType(), "at": T.TimestampNTZType(), "explicit": T.BooleanType(), "cue": T.BooleanType()}.items()]))


@F.arrow_udf(FOUND)
def _found(said: pa.Array, zone: pa.Array) -> pa.Array:
    """The dates of each text (each once, without at) and its clocks (without date)."""
    ends, found = [0], []
    for text, home in zip(said.to_pylist(), zone.to_pylist(), strict=True):
        stated = dates_in(text)
        found.extend((d, None, None, None) for d, _ in stated)
        found.extend((None, *c) for c in clocks_in(text, home, stated))
        ends.append(len(found))
    kinds = to_arrow_type(FOUND).value_type
    columns = [pa.array([x[k] for x in found], kinds.field(k).type) for k in range(kinds.num_fields)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kinds)))


def told(results: DataFrame, key: str = "ord", url: str = "url", said: str = "said") -> DataFrame:
    """key, organisation, date, at (UTC), explicit, cue: a row for each date that a page states (without at), each once, and for each of its clocks (without date).

    Equal texts of one zone are read once, and for both; ``settled``, this serves all that is asked of them.
    """
    page = results.select(key, F.coalesce(said, F.lit("")).alias("said"), verify.host(F.col(url)).alias("_host"))
    page = page.select(key, "said", verify.base_domain(F.col("_host")).alias("organisation"))
    zoned = page.select(key, "said", verify.zone_name(F.col("organisation")).alias("zone"), "organisation")
    read = texts.made_once(zoned, ["said", "zone"], {"found": _found("said", "zone")})
    return read.select(key, "organisation", F.inline("found")).withColumn("at", F.col("at").cast("timestamp"))


def dates(found: DataFrame, key: str = "ord") -> DataFrame:
    """key, date: every date that a page states, each once.  ``found``: of ``told``."""
    return found.where("date is not null").select(key, "date")


def clocks(found: DataFrame, key: str = "ord") -> DataFrame:
    """key, at (UTC), explicit, score, organisation, weight of every clock in every page.  ``found``: of ``told``."""
    score = F.when(F.col("explicit"), 100).otherwise(0) + F.when(F.col("cue"), 80).otherwise(0)
    return found.where("at is not null").select(key, "at", "explicit", score.alias("score"), "organisation", verify.occurrence_weight(F.col("organisation")).alias("weight"))


def candidates(results: DataFrame, key: str = "ord", url: str = "url", said: str = "said") -> DataFrame:
    """``clocks`` of pages of which no more is asked."""
    return clocks(told(results, key, url, said), key)


def _of_slots(slots: DataFrame, said: DataFrame, keys: list[str]) -> DataFrame:
    """What was said of each slot.  Never by broadcast: both have as many rows as there are events, and take far more memory than files, whose size the choice would go by."""
    return slots.join(said.hint("merge"), keys)


def verdicts(slots: DataFrame, found: DataFrame, keys: list[str], minutes: int = CONFIRM_MINUTES, stated: DataFrame | None = None, sources: bool = False) -> DataFrame:
    """Per slot: state, difference of the time it rests on, organisations; with ``sources`` the domains that stand behind it (all that confirm, or the one that told the nearest time).

    ``slots``: keys, start_at; ``found``: keys, at, weight, score, organisation; ``stated``: keys, date.
    Confirmed by one source of weight 100, or by two with 100 together, each organisation heard once; else
    any time at all is a mismatch, told by the nearest; without times, dates that are all more than a day
    from the slot's are a mismatch too; else unknown.
    """
    diff = _of_slots(slots, found, keys).withColumn("difference", minutes_between(F.col("start_at"), F.col("at")))
    near = F.abs(F.col("difference")) <= minutes
    most = [F.array_sort(F.collect_set(F.when(F.col("v").isNotNull(), F.col("organisation")))).alias("said_by")] if sources else []
    voice = F.struct("weight", "score", (-F.abs("difference")).alias("close"), "difference")
    away = F.struct(F.abs("difference").alias("far"), "difference", *(["organisation"] if sources else []))
    # each organisation's best time near the slot (null if it has none) and its nearest of all, in one go
    heard = diff.groupBy(*keys, "organisation").agg(F.max(F.when(near, voice)).alias("v"), F.min(away).alias("n"))
    tally = heard.groupBy(*keys).agg(F.count("v").alias("organisations"), F.sum("v.weight").alias("weight"), F.max("v").alias("best"), F.min("n").alias("nearest"), *most)
    out = slots.select(*keys, "start_at").join(tally, keys, "left")
    sure: Column = (F.col("best.weight") >= 100) | ((F.col("organisations") >= 2) & (F.col("weight") >= 100))
    elsewhere = F.lit(False)
    if stated is not None:
        days = _of_slots(slots, stated, keys).groupBy(*keys).agg(F.min(F.abs(F.date_diff("date", F.col("start_at").cast("date")))).alias("days"))
        out, elsewhere = out.join(days, keys, "left"), F.coalesce(F.col("days") > 1, F.lit(False))
    state = F.when(F.coalesce(sure, F.lit(False)), "confirmed_direct").when(F.col("nearest").isNotNull() | elsewhere, "mismatch").otherwise("unknown")
    told = F.when(state == "confirmed_direct", F.col("best.difference")).otherwise(F.col("nearest.difference"))
    reason = F.when(F.col("nearest").isNull() & elsewhere, "external_event_date_mismatch")
    if sources:
        domains = F.when(state == "confirmed_direct", F.col("said_by")).when(F.col("nearest").isNotNull(), F.array("nearest.organisation")).otherwise(F.array().cast("array<string>"))
        return out.select(*keys, state.alias("state"), told.alias("difference"), F.coalesce("organisations", F.lit(0)).alias("organisations"), reason.alias("reason"), domains.alias("domains"))
    return out.select(*keys, state.alias("state"), told.alias("difference"), F.coalesce("organisations", F.lit(0)).alias("organisations"), reason.alias("reason"))


def by_site(slots: DataFrame, found: DataFrame, keys: list[str], stated: DataFrame) -> DataFrame:
    """Per slot: state (confirmed, mismatch, unknown) and difference by what one trusted calendar's pages tell.

    A time from EARLIEST to LATEST minutes after the slot's start confirms it, the nearest of several, of equally near the one told
    most plainly; else any time is a mismatch, told by the nearest; without times, dates that are all more
    than a day off are one too.
    """
    diff = _of_slots(slots, found, keys).withColumn("difference", minutes_between(F.col("start_at"), F.col("at")))
    one = lambda d: F.struct(F.abs(d).alias("far"), (-F.col("score")).alias("plain"), d.alias("difference"))
    plausible = F.col("difference").between(EARLIEST, LATEST)
    told = diff.groupBy(*keys).agg(F.min(F.when(plausible, one(F.col("difference")))).alias("good"), F.min(one(F.col("difference"))).alias("nearest"))
    days = _of_slots(slots, stated, keys).groupBy(*keys).agg(F.min(F.abs(F.date_diff("date", F.col("start_at").cast("date")))).alias("days"))
    out = slots.select(*keys).join(told, keys, "left").join(days, keys, "left")
    state = F.when(F.col("good").isNotNull(), "confirmed").when(F.col("nearest").isNotNull() | F.coalesce(F.col("days") > 1, F.lit(False)), "mismatch").otherwise("unknown")
    return out.select(*keys, state.alias("state"), F.coalesce("good.difference", "nearest.difference").alias("difference"))


def site_first(slots: DataFrame, pages: DataFrame, site: str, key: str = "ord") -> DataFrame:
    """Per slot: state, by (site, official, none), difference: what the calendar's own pages tell; where they tell nothing, what all pages tell, if an official source stands behind it; else unknown.

    ``slots``: key, start_at; ``pages``: key (of the slot that it was found for), url, said.
    """
    found = settled(told(pages, key), "told")
    of_site = found.where(F.col("organisation") == site)
    own = by_site(slots, clocks(of_site, key), [key], dates(of_site, key))
    others = verdicts(slots, clocks(found, key), [key], stated=dates(found, key), sources=True)
    searched = others.select(key, F.when(F.col("state") == "confirmed_direct", "confirmed").otherwise(F.col("state")).alias("state"), "domains", F.col("difference").alias("_found"))
    verdict = verify.calendar_first(own, searched, key, keep=("difference", "_found"))
    difference = F.when(F.col("by") == "calendar", F.col("difference")).when(F.col("by") == "official", F.col("_found"))
    return verdict.select(key, "state", F.when(F.col("by") == "calendar", "site").otherwise(F.col("by")).alias("by"), difference.alias("difference"))
