"""Queries of titles and of times told by pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon, text, titles
from ..operators import occurrence, verify
from ..sources.shared import settled
from . import joined
from .adapter import bx, duck, table
from .basic import q, ts

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


_RAW = "case ord % 6 when 0 then 'Футбол. УЕФА Чемпиондар Лигасы. ' || title when 1 then 'Judo  Азия чемпионаты (Әйелдер)' when 2 then title || ' Шаңғы спорты' when 3 then 'ХОККЕЙ . Плей-офф кезеңі. 1\\4 финал. ' || title when 4 then 'Қазақстан чемпионаты. Іріктеу..' else title end"
_D_RUSSIAN = "x"
for _a, _b in ((r"1\4", "1/4"), (r"1\2", "1/2"), *titles.RUSSIAN_A):
    _D_RUSSIAN = f"replace({_D_RUSSIAN}, {q(_a)}, {q(_b)})"
_D_RUSSIAN = f"trim(replace(replace(regexp_replace({_D_RUSSIAN}, '\\s+', ' ', 'g'), ' .', '.'), '..', '.'), {q(titles.EDGES)})"
_SPORT = lambda c: f"coalesce(case lower({c}) " + " ".join(f"when {q(k.lower())} then {q(v)}" for k, v in titles.SPORTS_A.items()) + " end, '')"
_FIRST = q(rf"^({titles._names(titles.SPORTS_A)})(?:\s*\.\s*|\s+)")
_LAST = q(rf"^(.*?)\s+({titles._names(titles.SPORTS_A)})$")
_TITLES = f"raw as (select ord, {_RAW} as x from bx)"


def _raw(spark, sf_dir):
    return bx(spark, sf_dir).select("ord", F.expr(_RAW.replace("\\4", "\\\\4")).alias("x"))


@query(duck(f"select ord, {_D_RUSSIAN} as russian from raw", _TITLES))
def russian_titles(spark, sf_dir):
    return _raw(spark, sf_dir).select("ord", titles.russian(F.col("x")).alias("russian"))


@query(duck(f"select ord, {_SPORT(f'regexp_extract(x, {_FIRST}, 1, {q(chr(105))})')} as sport, case when regexp_matches(x, {_FIRST}, 'i') then trim(regexp_replace(x, {_FIRST}, '', 'i'), {q(titles.EDGES)}) else x end as rest from raw", _TITLES))
def title_sport_first(spark, sf_dir):
    return _raw(spark, sf_dir).select("ord", titles.sport_first(F.col("x")).alias("s")).select("ord", "s.sport", "s.rest")


@query(duck(f"select ord, {_SPORT(f'regexp_extract(x, {_LAST}, 2, {q(chr(105))})')} as sport, case when regexp_matches(x, {_LAST}, 'i') then trim(regexp_extract(x, {_LAST}, 1, 'i'), {q(titles.EDGES)}) else x end as rest from raw", _TITLES))
def title_sport_last(spark, sf_dir):
    return _raw(spark, sf_dir).select("ord", titles.sport_last(F.col("x")).alias("s")).select("ord", "s.sport", "s.rest")


_PARTS = "parts as (select ord, x, list_filter(list_transform(string_split(x, '.'), lambda s: trim(s)), lambda s: s <> '') as p from raw)"
_AT = "places as (select ord, x, p, list_max(list_filter(range(1, len(p) + 1), lambda i: regexp_matches(p[i], '\\s+[–—-]\\s+'))) as k from parts)"


@query(duck("select ord, case when k is null then x when k = 1 then '' else array_to_string(p[1:k - 1], '. ') end as tournament, case when k is null then x else array_to_string(p[k:], '. ') end as title from places", _TITLES, _PARTS, _AT))
def title_by_segments(spark, sf_dir):
    return _raw(spark, sf_dir).select("ord", titles.by_segments(F.col("x")).alias("s")).select("ord", "s.tournament", "s.title")


@query(duck("select ord, trim(regexp_replace(x, '[\\s.,-]*(прямая трансляция|прямой эфир|тікелей эфир|live)(\\s+из\\s+.*)?[\\s.!]*$', '', 'i'), ' .,-') as stripped from said", "said as (select ord, title || case ord % 4 when 0 then '. Прямая трансляция из Алматы' when 1 then ' LIVE' when 2 then ' - ПРЯМОЙ ЭФИР!' else '' end as x from bx)"))
def live_stripped(spark, sf_dir):
    said = F.expr("title || case ord % 4 when 0 then '. Прямая трансляция из Алматы' when 1 then ' LIVE' when 2 then ' - ПРЯМОЙ ЭФИР!' else '' end")
    return bx(spark, sf_dir).select("ord", text.strip_live(said).alias("stripped"))


# pages about events: the same clock told in several zones
_TOLD = "case event_id % 5 when 0 then 'Kick-off ' || {iso} || ' at ' || {clock} || ' UTC' when 1 then {dmy} || ', начало в ' || {clock} || ' МСК' when 2 then 'On ' || {iso} || ' from ' || {clock} || ' EST' when 3 then {dmy} || ' в ' || {clock} else 'Main card ' || {half} || ' ET, ' || {worded} end"
_URL = "case event_id % 3 when 0 then 'https://www.uefa.com/m/' when 1 then 'https://news.sports.ru/' else 'http://example.com/' end"


def _told(spark, sf_dir):
    said = _TOLD.format(iso="date_format(ts, 'yyyy-MM-dd')", dmy="date_format(ts, 'dd.MM.yyyy')", clock="date_format(ts, 'HH:mm')", half="date_format(ts, 'h:mm a')", worded="date_format(ts, 'MMMM d, yyyy')")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), "user_id", "ts", F.expr(_URL).alias("url"), F.expr(said).alias("said"))


# Clocks with a zone that they go with; and on pages of sports.ru, whose clocks are Moscow's, bare numbers: the day and month of a
# date, if they can be hours, and the clock itself where no zone follows it.
_ORG = "case event_id % 3 when 0 then 'uefa.com' when 1 then 'sports.ru' else 'example.com' end"
_CANDIDATES = f"""minutes as (select *, date_trunc('minute', ts) as mi, date_trunc('day', ts) as d0 from events),
clocks as (
  select event_id, user_id, ts, mi + to_hours(case event_id % 5 when 1 then -3 when 4 then 5 else 0 end) as "at", true as explicit from minutes where event_id % 5 in (0, 1, 4)
  union all select event_id, user_id, ts, mi + to_hours(-3), false from minutes where event_id % 3 = 1 and event_id % 5 = 3
  union all select event_id, user_id, ts, d0 + to_hours(cast(month(ts) as integer) - 3), false from minutes where event_id % 3 = 1 and event_id % 5 <> 4
  union all select event_id, user_id, ts, d0 + to_hours(cast(day(ts) as integer) - 3), false from minutes where event_id % 3 = 1 and day(ts) <= 23),
told as (select event_id as ord, user_id, ts, "at", explicit, case when explicit then 100 else 0 end + case when event_id % 5 in (0, 1, 4) then 80 else 0 end as score, {_ORG} as organisation, case event_id % 3 when 0 then 100 when 1 then 70 else 40 end as weight from clocks)"""


@query(f"with {_CANDIDATES} select ord, strftime(\"at\", '%Y-%m-%d %H:%M') as at_text, explicit, score, organisation, weight from told")
def dated_candidates(spark, sf_dir):
    got = occurrence.candidates(_told(spark, sf_dir))
    return got.select("ord", ts("at").alias("at_text"), "explicit", "score", "organisation", "weight")


@query(
    f"with {_CANDIDATES}, slots as (select user_id, strftime(ts, '%Y-%m-%d') as day, min(date_trunc('minute', ts)) as start_at from events group by all), "
    "d as (select s.user_id, s.day, t.*exclude(user_id), cast(trunc(date_diff('second', s.start_at, t.\"at\") / 60) as bigint) as difference from slots s join told t on t.user_id = s.user_id and strftime(t.ts, '%Y-%m-%d') = s.day), "
    "heard as (select user_id, day, organisation, weight, score, difference from d where abs(difference) <= 30 qualify row_number() over (partition by user_id, day, organisation order by weight desc, score desc, abs(difference), difference desc) = 1), "
    "tally as (select user_id, day, count(*) as organisations, sum(weight) as total, max(weight) as top, arg_max(difference, row(weight, score, -abs(difference), difference)) as best from heard group by all), "
    "close as (select user_id, day, arg_min(difference, row(abs(difference), difference)) as nearest from d group by all) "
    "select s.user_id, s.day, case when coalesce(top >= 100 or (organisations >= 2 and total >= 100), false) then 'confirmed_direct' when nearest is not null then 'mismatch' else 'unknown' end as state, coalesce(case when coalesce(top >= 100 or (organisations >= 2 and total >= 100), false) then best else nearest end, -99999) as difference, coalesce(organisations, 0) as organisations from slots s left join tally using (user_id, day) left join close using (user_id, day)"
)
def occurrence_verdict(spark, sf_dir):
    told = _told(spark, sf_dir)
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    slots = told.groupBy("user_id", day).agg(F.min(F.date_trunc("minute", "ts")).alias("start_at"))
    found = occurrence.candidates(told).join(told.select("ord", "user_id", day), "ord")
    return occurrence.verdicts(slots, found, ["user_id", "day"]).withColumn("difference", F.coalesce("difference", F.lit(-99999))).drop("reason")


# pages that state dates only, some of another day than the slot's
@query("select event_id as ord, case when event_id % 4 >= 2 then 'mismatch' else 'unknown' end as state, case when event_id % 4 >= 2 then 'external_event_date_mismatch' else '' end as reason, 1 + cast(event_id % 2 = 1 as int) as n_dates from events")
def occurrence_dates(spark, sf_dir):
    shift = "date_add(cast(ts as date), cast(event_id % 4 as int))"
    said = F.expr(f"'The final is on ' || date_format({shift}, 'd MMMM yyyy') || case when event_id % 2 = 1 then ' or ' || date_format(date_add({shift}, 7), 'dd/MM/yyyy') || ', not 99.99.2024' else ' (' || date_format({shift}, 'yyyy-MM-dd') || ')' end")
    pages = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.date_trunc("minute", "ts").alias("start_at"), F.lit("http://example.com/").alias("url"), said.alias("said"))
    found = settled(occurrence.told(pages), "told")
    stated = occurrence.dates(found)
    out = occurrence.verdicts(pages.select("ord", "start_at"), occurrence.clocks(found), ["ord"], stated=stated)
    return out.join(stated.groupBy("ord").agg(F.count("*").cast("int").alias("n_dates")), "ord").select("ord", "state", F.coalesce("reason", F.lit("")).alias("reason"), "n_dates")


# the calendar first, then official pages: both verdicts are those of the queries above and of calendar_reconcile_texts
_SLOTTED = (
    "slots as (select ord, start_at from bx)",
    "d as (select s.ord, t.organisation, t.weight, t.score, cast(trunc(date_diff('second', s.start_at, t.\"at\") / 60) as bigint) as difference from slots s join told t using (ord))",
    "heard as (select ord, organisation, max(weight) as weight from d where abs(difference) <= 30 group by all)",
    "tally as (select ord, count(*) as organisations, sum(weight) as total, max(weight) as top, list(organisation) as said_by from heard group by ord)",
    "close as (select ord, arg_min(organisation, row(abs(difference), difference, organisation)) as nearest from d group by ord)",
    "searched as (select ord, case when coalesce(top >= 100 or (organisations >= 2 and total >= 100), false) then 'confirmed' when nearest is not null then 'mismatch' else 'unknown' end as found, case when coalesce(top >= 100 or (organisations >= 2 and total >= 100), false) then said_by when nearest is not null then [nearest] else [] end as domains from slots left join tally using (ord) left join close using (ord))",
    "gated as (select ord, found, found <> 'unknown' and len(list_filter(domains, lambda x: x in ({0}))) > 0 as official from searched)".format(", ".join(map(q, lexicon.OFFICIAL_EVENT_DOMAINS))),
)


@query(
    duck(
        "select ord, case when c.state <> 'unknown' then c.state when official then found else 'unknown' end as state, case when c.state <> 'unknown' then 'calendar' when official then 'official' else 'none' end as by from reconciled c join gated using (ord)",
        f"reconciled as ({joined.QUERIES['calendar_reconcile_texts'][1]})",
        _CANDIDATES,
        *_SLOTTED,
    )
)
def calendar_first_verdict(spark, sf_dir):
    """Every slot by the calendar's texts, and where they tell nothing by pages about it, if an official source stands behind them."""
    cal = joined.calendar_reconcile_texts(spark, sf_dir).select("ord", "state")
    found = occurrence.candidates(_told(spark, sf_dir))
    slots = bx(spark, sf_dir).select("ord", "start_at")
    searched = occurrence.verdicts(slots, found, ["ord"], sources=True)
    return verify.calendar_first(cal, searched.withColumn("state", F.when(F.col("state") == "confirmed_direct", "confirmed").otherwise(F.col("state"))))


# pages of the calendar's site for some slots: a clock some minutes off, or another day; pages of other sites for all
_SITE_SAID = "case when event_id % 4 = 0 then 'The match, ' || {at} || ' UTC' else 'A match on ' || {on} end"


@query(
    "with "
    + _CANDIDATES
    + ", site as (select event_id as ord, mi, event_id % 4 as k, mi + to_minutes(cast((event_id % 7) * 15 as integer)) as told_at, cast(mi as date) + cast(event_id % 3 as integer) as on_day from minutes where event_id % 4 < 2), "
    # on the site's pages, whose clocks are Moscow's, the month and day of a date are hours too
    "site_clocks as (select ord, mi, told_at as \"at\", 100 as score from site where k = 0 union all select ord, mi, date_trunc('day', told_at) + to_hours(cast(month(told_at) as integer) - 3), 0 from site where k = 0 union all select ord, mi, date_trunc('day', told_at) + to_hours(cast(day(told_at) as integer) - 3), 0 from site where k = 0 and day(told_at) <= 23 "
    "union all select ord, mi, cast(on_day as timestamp) + to_hours(cast(month(on_day) as integer) - 3), 0 from site where k = 1 union all select ord, mi, cast(on_day as timestamp) + to_hours(cast(day(on_day) as integer) - 3), 0 from site where k = 1 and day(on_day) <= 23), "
    "slots as (select event_id as ord, mi as start_at from minutes), "
    "sd as (select ord, score, cast(trunc(date_diff('second', mi, \"at\") / 60) as bigint) as difference from site_clocks), "
    "own as (select ord, min(row(abs(difference), -score, difference)) filter (where difference between -10 and 45) as good, min(row(abs(difference), -score, difference)) as nearest from sd group by ord), "
    "d as (select s.ord, t.organisation, t.weight, t.score, cast(trunc(date_diff('second', s.start_at, t.\"at\") / 60) as bigint) as difference from slots s join told t using (ord) union all select ord, 'championat.com', 70, score, difference from sd), "
    "heard as (select ord, organisation, weight, score, difference from d where abs(difference) <= 30 qualify row_number() over (partition by ord, organisation order by weight desc, score desc, abs(difference), difference desc) = 1), "
    "tally as (select ord, count(*) as organisations, sum(weight) as total, max(weight) as top, list(organisation) as said_by, arg_max(difference, row(weight, score, -abs(difference), difference)) as best from heard group by ord), "
    "close as (select ord, min(row(abs(difference), difference, organisation)) as nearest from d group by ord), "
    "searched as (select ord, coalesce(top >= 100 or (organisations >= 2 and total >= 100), false) as sure, nearest, said_by, best from slots left join tally using (ord) left join close using (ord)), "
    "gated as (select ord, case when sure then 'confirmed' when nearest is not null then 'mismatch' else 'unknown' end as found, case when sure then best else nearest[2] end as away, len(list_filter(case when sure then said_by when nearest is not null then [nearest[3]] else [] end, lambda x: x in ({0}))) > 0 as official from searched) ".format(", ".join(map(q, lexicon.OFFICIAL_EVENT_DOMAINS)))
    + "select ord, case when good is not null then 'confirmed' when own.nearest is not null then 'mismatch' when official and found <> 'unknown' then found else 'unknown' end as state, case when own.nearest is not null then 'site' when official and found <> 'unknown' then 'official' else 'none' end as by, coalesce(case when good is not null then good[3] when own.nearest is not null then own.nearest[3] when official and found <> 'unknown' then away end, -99999) as difference from gated left join own using (ord)"
)
def site_first_verdict(spark, sf_dir):
    """Every slot by the pages of one trusted calendar, and where it has none by official pages."""
    e = table(spark, sf_dir, "events").withColumn("mi", F.date_trunc("minute", "ts"))
    at = "date_format(mi + make_dt_interval(0, 0, cast((event_id % 7) * 15 as int), 0), 'yyyy-MM-dd HH:mm')"
    on = "date_format(date_add(cast(mi as date), cast(event_id % 3 as int)), 'yyyy-MM-dd')"
    site = e.where("event_id % 4 < 2").select(F.col("event_id").alias("ord"), F.lit("https://www.championat.com/match/").alias("url"), F.expr(_SITE_SAID.format(at=at, on=on)).alias("said"))
    pages = _told(spark, sf_dir).select("ord", "url", "said").unionByName(site)
    return occurrence.site_first(e.select(F.col("event_id").alias("ord"), F.col("mi").alias("start_at")), pages, "championat.com").withColumn("difference", F.coalesce("difference", F.lit(-99999)))
