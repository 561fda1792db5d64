"""Queries of guide titles, guide pages, evidence and provider listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence, lexicon, titles
from ..operators import epg, reconcile
from ..sources import calendars, guides, listings
from .adapter import bx, duck
from .basic import alternation, q
from .told import _FIRST, _LAST, _SPORT

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


def d_russian(x: str) -> str:
    out = x
    for a, b in ((r"1\4", "1/4"), (r"1\2", "1/2"), *titles.RUSSIAN_A):
        out = f"replace({out}, {q(a)}, {q(b)})"
    return f"trim(replace(replace(regexp_replace({out}, '\\s+', ' ', 'g'), ' .', '.'), '..', '.'), {q(titles.EDGES)})"


# titles of the guide of links ---------------------------------------------------------------
_RAW = "case ord % 12 when 0 then 'Футбол. УЕФА Чемпиондар Лигасы, жалпы кезеңнің жеребе тарту рәсімі' when 1 then 'УЕФА Еуропа Лигасы. жеребе тартуы' when 2 then 'Волейбол. УЕФА Конференциялар Лигасы жеребе' when 3 then 'Футбол Қазақстан чемпионаты. 5 тур. ' || title when 4 then 'Judo Grand Slam. Astana Дзюдо' when 5 then 'Теннис. Студиялық бағдарлама. Матч қарсаңында' when 6 then 'QJ League - ' || title when 7 then 'Азия чемпионаты іріктеу турнирі. ' || title || ' Баскетбол' when 8 then 'Хоккей. Плей-офф кезеңі ' || title when 9 then 'Азия кубогы-2029 (Әйелдер) ' || title when 10 then 'Дзюдо. Grand Slam' else title end"
_MARK_END = "case " + " ".join(f"when contains(rest, {q(m)}) then strpos(rest, {q(m)}) + {len(m) - 1}" for m in titles.MARKS_A) + " end"
_CUP = "case " + " ".join(f"when regexp_matches(low, {q(p)}) then {q(n)}" for p, n in titles.DRAWS_A) + " end"


def _named(source: str, x: str) -> tuple[str, ...]:
    """Common tables that end in ``named`` (all of ``source`` with sport, tournament, name)."""
    return (
        f"s0 as (select *, {_SPORT(f'regexp_extract({x}, {_FIRST}, 1, {q(chr(105))})')} as sp1, {_SPORT(f'regexp_extract({x}, {_LAST}, 2, {q(chr(105))})')} as sp2 from {source})",
        f"s1 as (select *, case when sp1 <> '' then sp1 else sp2 end as sp, case when sp1 <> '' then trim(regexp_replace({x}, {_FIRST}, '', 'i'), {q(titles.EDGES)}) when sp2 <> '' then trim(regexp_extract({x}, {_LAST}, 1, 'i'), {q(titles.EDGES)}) else trim({x}) end as rest from s0)",
        f"s2 as (select *, lower(rest) as low, {d_russian('rest')} as ru, {_MARK_END} as mark from s1)",
        f"s3 as (select *, {_CUP} as cup, list_filter(list_transform(string_split(ru, '.'), lambda s: trim(s)), lambda s: s <> '') as parts, {d_russian('trim(regexp_replace(rest, ' + q('(^|[^а-яёa-z])(дзюдо|judo)($|[^а-яёa-z])') + ', ' + q(chr(92) + '1' + chr(92) + '3') + ', ' + q('gi') + '), ' + q(titles.EDGES) + ')')} as bare, {d_russian('trim(substr(rest, 1, mark), ' + q(' .') + ')')} as mt, {d_russian('trim(substr(rest, mark + 1), ' + q(titles.EDGES) + ')')} as me, {d_russian('trim(substr(rest, 10), ' + q(titles.EDGES) + ')')} as youth from s2)",
        "s4 as (select *, case when cup is not null and contains(low, 'жеребе') then 1 when starts_with(lower(ru), 'чемпионат казахстана') then 2 when contains(low, 'grand slam') and (sp = 'Дзюдо' or contains(low, 'дзюдо') or contains(low, 'judo')) then 3 when starts_with(low, 'студиялық бағдарлама') then 4 when starts_with(low, 'qj league') then 5 when mark is not null then 6 else 7 end as rule from s3)",
        "named as (select * exclude (sp1, sp2), case rule when 1 then case when sp = '' then 'Футбол' else sp end when 3 then 'Дзюдо' when 4 then '' else sp end as sport_named, case rule when 1 then cup when 2 then parts[1] when 3 then 'Grand Slam' when 5 then 'QJ League' when 6 then mt else '' end as tournament_named, case rule when 1 then case when contains(low, 'жалпы кезең') then 'Жеребьёвка общего этапа' else 'Жеребьёвка' end when 2 then case when len(parts) > 1 then array_to_string(parts[2:], '. ') else parts[1] end when 3 then case when bare = '' then 'Grand Slam' else bare end when 5 then youth when 6 then me else ru end as title_named from s4)",
    )


@query(duck("select ord, sport_named as sport, tournament_named as tournament, title_named as title from named", f"raws as (select ord, {_RAW} as x from bx)", *_named("raws", "x")))
def guide_a_titles(spark, sf_dir):
    return bx(spark, sf_dir).select("ord", titles.guide_title(F.expr(_RAW)).alias("t")).select("ord", "t.*")


# pages of the guide of links ----------------------------------------------------------------
_LISTED = "(case when sport = '' then '' else sport || '. ' end) || title"
_ON_NOW = "case cast(substr(date, 9, 2) as int) % 3 when 0 then '12:34' when 1 then '23:59' else '' end"


def _pages_a(spark, sf_dir):
    """A page for each channel and day: badges within rows, marks in the text of rows, marks between rows, and a banner on some days."""
    rows = bx(spark, sf_dir).withColumn("listed", F.expr(_LISTED)).select("channel", "date", F.struct("time", "ord", "listed", F.expr("is_live_broadcast and ord % 4 = 0").alias("badge"), F.expr("is_live_broadcast and ord % 4 = 1").alias("told"), F.expr("is_live_broadcast and ord % 4 = 2").alias("gap")).alias("r"))
    line = lambda r: F.concat(F.when(r["gap"], "<i data-state='is live'></i>").otherwise(""), F.lit('<a href="x"><div>'), F.when(r["told"], "live  ").otherwise(""), r["time"], F.lit("</div><div>"), r["listed"], F.lit("</div>"), F.when(r["badge"], '<img src="/img/live.png">').otherwise(""), F.lit("</a>\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), line), "")
    on_now = F.expr(_ON_NOW)
    banner = F.when(on_now != "", F.concat(F.lit("<p>Сейчас в <b>эфире</b> LIVE "), on_now, F.lit(" <b>Футбол. Канал "), F.col("channel"), F.lit("</b> Смотреть онлайн</p>"))).otherwise("")
    return rows.groupBy("channel", "date").agg(body.alias("body")).select(F.concat_ws("/", "channel", "date").alias("page"), F.concat(banner, F.col("body")).alias("html"))


# a mark in the markup before a time; a badge behind a time is before the next one
_PAGE_A = (
    f"listed as (select channel || '/' || date as page, channel, date, time, ord, {_LISTED} as x, is_live_broadcast and ord % 4 = 0 as badge, is_live_broadcast and ord % 4 = 1 as told, is_live_broadcast and ord % 4 = 2 as gap, cast(substr(time, 1, 2) as int) * 60 + cast(substr(time, 4, 2) as int) as m from bx)",
    "ranked as (select *, lag(badge) over (partition by page order by time, ord) as behind from listed)",
    "once as (select * from ranked qualify row_number() over (partition by page, time, x order by ord) = 1)",
    f"spans as (select page, any_value(channel) as channel, min(m) as low, max(m) as high, any_value({_ON_NOW}) as on_now from once group by page)",
    "placed as (select page, on_now, 'Футбол. Канал ' || channel as x, (select min(row(not (o.m between low and high), case when o.m between low and high then 0 else least(abs(o.m - low), abs(o.m - high)) end, o.m)) from (select cast(substr(on_now, 1, 2) as int) * 60 + cast(substr(on_now, 4, 2) as int) + k * 1440 as m from (values (0), (1), (2)) as v(k)) o) as best from spans where on_now <> '')",
    "scanned as (select page, time, x, told as is_live, badge as has_badge, m as am from once union all select page, on_now, x, true, false, best[3] from placed)",
)


def _scan_a(spark, sf_dir):
    pages = _pages_a(spark, sf_dir)
    return pages, guides.with_banner(guides.anchors(pages, "page", "html"), guides.banner(pages, "page", "html"), "page")


@query(duck("select page, time, x as title, is_live, has_badge, cast(am as bigint) as at_minute from scanned", *_PAGE_A))
def guide_a_scan(spark, sf_dir):
    _, rows = _scan_a(spark, sf_dir)
    return rows.select("page", "time", "title", "is_live", "has_badge", F.col("offset").cast("long").alias("at_minute"))


_BADGES = "badges as (select distinct page, time from once where badge)"
_TOLD_TIMES = "told_times as (select distinct page, time from ranked where told or gap or coalesce(behind, false) union select page, on_now from spans where on_now <> '')"


@query(
    duck(
        "select n.page, n.time, n.x as title, case when b.time is not null then 'official_live_badge' when t.time is not null then 'guide_page_live_text' else '' end as method, case when b.time is not null then 'high' when t.time is not null then 'medium' else '' end as confidence, (b.time is not null or t.time is not null) and sport_named <> '' as direct, case when b.time is not null or t.time is not null then sport_named else '' end as sport from named n left join badges b on b.page = n.page and b.time = n.time left join told_times t on t.page = n.page and t.time = n.time",
        *_PAGE_A,
        *_named("scanned", "x"),
        _BADGES,
        _TOLD_TIMES,
    )
)
def guide_a_confirmed(spark, sf_dir):
    pages, rows = _scan_a(spark, sf_dir)
    empty = lambda c: F.coalesce(c, F.lit(""))
    return guides.confirmed(rows, pages, "page", "html").select("page", "time", "title", empty("method").alias("method"), empty("confidence").alias("confidence"), "direct", empty(F.col("named.sport")).alias("sport"))


# evidence -----------------------------------------------------------------------------------
_HELD = "case ord % 3 when 0 then '' when 1 then 'official_live_badge' else 'third_party_live_badge' end"
_ADDED = "case ord % 5 when 0 then 'official_live_badge' when 1 then 'third_party_live_text' when 2 then 'official_on_air_marker' when 3 then 'third_party_live_badge' else 'external_note' end"


@query(duck(f"select ord, array_to_string(m, ',') as methods, list_contains(m, 'official_on_air_marker') as on_air, list_contains(m, 'official_live_badge') as claimed, list_contains(m, 'third_party_live_badge') or list_contains(m, 'third_party_live_text') as third_claimed, case when list_contains(m, 'official_live_badge') then 'high' when list_contains(m, 'third_party_live_badge') or list_contains(m, 'third_party_live_text') then 'medium' else '' end as strength from u", f"h as (select ord, {_HELD} as a, {_ADDED} as b from bx)", "u as (select ord, case when a = '' then [b] when a = b then [a] else [a, b] end as m from h)"))
def evidence_union(spark, sf_dir):
    lit = F.lit
    held, added = F.expr(_HELD), F.expr(_ADDED)
    one = F.array(F.struct(held.alias("method"), lit("guide").alias("source"), lit("LIVE").alias("value"), lit("high").alias("confidence"))).cast(evidence.EVIDENCE)
    before = F.when(held == "", F.array().cast(evidence.EVIDENCE)).otherwise(one)
    got = bx(spark, sf_dir).select("ord", evidence.with_evidence(before, added, lit("guide"), lit("LIVE"), lit("high")).alias("e"))
    return got.select("ord", F.array_join(F.transform("e", lambda x: x["method"]), ",").alias("methods"), evidence.claims(F.col("e")).alias("c")).select("ord", "methods", "c.*")


_LINE = "case ord % 6 when 0 then title || ' LIVE' when 1 then 'Повтор. ' || title || ' Прямой эфир' when 2 then 'Тікелей эфир ' || title when 3 then 'ОБЗОР live' when 4 then 'Прямая трансляция' else title end"


@query(duck("select ord, ord % 6 in (2, 4) as direct from bx"))
def marker_direct(spark, sf_dir):
    return bx(spark, sf_dir).select("ord", evidence.direct_by_marker(F.expr(_LINE)).alias("direct"))


# provider listings --------------------------------------------------------------------------
_EPG_TITLE = "case ord % 7 when 0 then 'Кубок. Тур 3. ' || title when 1 then 'Обзор тура' when 2 then 'Теннис ' || (2022 + ord % 3) when 3 then 'Новый день' when 4 then 'Анонс ' || ord else title end"
_EPG = (
    f"listing as (select ord, channel, date, {_EPG_TITLE} as title, case when ord % 2 = 0 then tournament else '' end as tournament, sport, is_live_broadcast and ord % 3 = 0 as claimed from bx)",
    "hinted as (select *, lower(title || ' ' || title || ' ' || tournament) as said0 from listing)",
    "split0 as (select *, case when trim(sport) = '' then coalesce(case " + " ".join(f"when contains(said0, {q(w)}) then {q(v)}" for w, v in lexicon.SPORT_HINTS) + " end, '') else sport end as sport_now, list_filter(list_transform(string_split(title, '. '), lambda s: trim(s, ' .,-–—')), lambda s: s <> '') as parts from hinted)",
    "split1 as (select *, trim(tournament) = '' and len(parts) >= 2 and regexp_matches(parts[-1], '\\s-\\s|[–—]|\\s(?:vs\\.?|v\\.)\\s', 'i') as parted from split0)",
    "split2 as (select ord, channel, date, claimed, sport_now, case when parted then trim(array_to_string(parts[:-2], '. '), ' .,-–—') else tournament end as tournament_now, case when parted then parts[-1] else title end as title_now, title as raw from split1)",
    "said as (select *, lower(raw || ' ' || title_now || ' ' || tournament_now) as s from split2)",
    "keyed_epg as (select *, row_number() over (partition by channel, trim(regexp_replace(s, '\\s+', ' ', 'g')) order by date, ord) > 1 as repeated from said)",
    f"judged as (select *, regexp_matches(s, {alternation(lexicon.EPG_REPLAY)}) as replay, len(regexp_extract_all(s, '(?:^|[^0-9])(20[0-9][0-9])(?:[^0-9]|$)', 1)) > 0 and not list_contains(regexp_extract_all(s, '(?:^|[^0-9])(20[0-9][0-9])(?:[^0-9]|$)', 1), substr(date, 1, 4)) as stale, regexp_matches(s, '\\s-\\s|[–—]|\\s(?:vs\\.?|v\\.)\\s', 'i') or regexp_matches(s, {alternation(lexicon.EPG_EVENT)}) as eventful from keyed_epg)",
)


@query(duck("select ord, sport_now as sport, tournament_now as tournament, title_now as title, case when replay then 'provider_replay_or_editorial' when stale then 'provider_stale_year' when repeated then 'provider_repeat_epg' when claimed then 'provider_live_unverified' when eventful then 'provider_epg_sport_candidate' else 'provider_epg_only' end as method, case when replay or stale or repeated then 'replay' else 'unverified' end as state, eventful and not (replay or stale or repeated) as is_sport_event from judged", *_EPG))
def epg_classify(spark, sf_dir):
    rows = bx(spark, sf_dir).select("ord", "channel", "date", F.expr(_EPG_TITLE).alias("title"), F.expr("case when ord % 2 = 0 then tournament else '' end").alias("tournament"), "sport", F.expr("is_live_broadcast and ord % 3 = 0").alias("claimed")).withColumn("raw_title", F.col("title"))
    return epg.classified(rows).select("ord", "sport", "tournament", "title", "method", "state", "is_sport_event")


@query(duck("select ord, strftime(start_at, '%Y-%m-%dT%H:%M:%SZ') as source_start, strftime(start_at + interval 5 hour + case when start_at < timestamp '2024-02-29 18:00:00' then interval 1 hour else interval 0 hour end, '%Y-%m-%d') as date, strftime(start_at + interval 5 hour + case when start_at < timestamp '2024-02-29 18:00:00' then interval 1 hour else interval 0 hour end, '%H:%M') as time from bx"))
def epg_localised(spark, sf_dir):
    rows = bx(spark, sf_dir).select("ord", "start_at", F.col("slot_end").alias("end_at"))
    return epg.localised(rows).select("ord", "source_start", "date", "time")


@query(duck("select ord, state = 'confirmed' as is_live_broadcast, state = 'confirmed' as is_sport_event, case state when 'confirmed' then 'live' when 'mismatch' then 'not_live' else 'unknown' end as live_state from (select ord, case ord % 3 when 0 then 'confirmed' when 1 then 'mismatch' else 'unknown' end as state from bx)"))
def reconcile_outcome(spark, sf_dir):
    rows = bx(spark, sf_dir).select("ord", F.expr("case ord % 3 when 0 then 'confirmed' when 1 then 'mismatch' else 'unknown' end").alias("state"))
    return reconcile.outcome(rows).select("ord", "is_live_broadcast", "is_sport_event", "live_state")


@query(duck("select base, channel, case when right(channel, 1) in ('3', '7') then 'no schedule id: ' || channel else 'id' || channel end as said from (select distinct source as base, channel from bx)"))
def epg_channel_ids(spark, sf_dir):
    channels = bx(spark, sf_dir).select(F.col("source").alias("base"), "channel").distinct()
    ids = channels.where("right(channel, 1) not in ('3', '7')").withColumn("id", F.concat(F.lit("id"), "channel"))
    known, missing = epg.with_schedule(channels, ids)
    return known.select("base", "channel", F.col("id").alias("said")).unionByName(missing.withColumnRenamed("error", "said"))


@query(duck("select channel, date, case when d % 5 = 0 then 'no payload' when d % 7 = 0 then 'unreadable payload' else '' end as error from (select distinct channel, date, cast(substr(date, 9, 2) as int) as d from bx)"))
def epg_fan_out(spark, sf_dir):
    """Every channel and day is a scope of its own: what cannot be read is told and stops no other."""
    scopes = bx(spark, sf_dir).select("channel", "date").distinct()
    day = F.substring("date", 9, 2).cast("int")
    payloads = scopes.where(day % 5 != 0).withColumn("body", F.when(day % 7 == 0, "<html>").otherwise('{"pages":[]}'))
    good, bad = epg.fetched(scopes, payloads, F.from_json("body", guides.EPG)["pages"].isNotNull())
    return good.select("channel", "date", F.lit("").alias("error")).unionByName(bad)


# the guide of strings -----------------------------------------------------------------------
_B_TITLE = "case when ord % 9 = 0 then 'АТ СПОРТЫ. АТ ЖАРЫСЫ МАУСЫМЫ. 3 күн' when sport = '' then 'Новости' else upper(sport) || '. ' || tournament || ' . Қазақстан чемпионаты. ' || title end || case ord % 4 when 0 then '. Прямая трансляция из Алматы' when 1 then '. ТІКЕЛЕЙ ЭФИР' when 2 then ' Повтор. Прямой эфир' else '' end"
_B_KEEP = "ord % 4 in (0, 1) and (sport <> '' or ord % 9 = 0)"


def _pages_b(spark, sf_dir):
    """A page for each channel and day, from seven in the morning to seven: two day labels, then clocks and titles of all rows in order."""
    rows = bx(spark, sf_dir).withColumn("day", F.to_date(F.col("start_at") - F.expr("interval 7 hours")))
    line = lambda r: F.concat(F.lit("<li><span>"), r["time"], F.lit("</span>"), F.when(r["ord"] % 5 == 0, '<div class="x blink"><a title="LIVE" href="#"></a></div>').otherwise(""), F.lit("<p>"), r["said"], F.lit("</p></li>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_at", "ord", "time", F.expr(_B_TITLE).alias("said")))), line), "")
    label = lambda d: F.concat(F.lit("<b>день "), F.date_format(d, "dd.MM"), F.lit("</b>"))
    day = F.col("day")
    return rows.groupBy("channel", "day").agg(body.alias("body")).select(F.concat_ws("/", "channel", day.cast("string")).alias("page"), F.concat(label(day), label(F.date_add(day, 1)), F.lit("<ul>"), F.col("body"), F.lit("</ul>")).alias("html"))


# A row's date is its own, but on pages that have nothing from seven on and so do not show that midnight has passed: there it is the page's, until six.
_PAGE_B = (
    f"rows_b as (select channel || '/' || strftime(start_at - interval 7 hour, '%Y-%m-%d') as page, strftime(start_at - interval 7 hour, '%Y-%m-%d') as page_day, date as own_day, time, ord, {_B_TITLE} as said, sport, tournament, title, {_B_KEEP} as kept from bx)",
    "known_b as (select *, bool_or(time >= '07:00') over (partition by page) as late, bool_or(time < '06:00') over (partition by page) as early from rows_b)",
    "minutes_b as (select * exclude (own_day), case when late or (time >= '06:00' and early) then own_day else page_day end as date from known_b)",
)


@query(duck("select page, date, time, case when ord % 9 = 0 then 'Конный спорт' else sport end as sport, case when ord % 9 = 0 then 'Сезон конных скачек' else tournament || '. Чемпионат Казахстана' end as tournament, case when ord % 9 = 0 then 'Сезон конных скачек. 3 күн' else case when title = upper(title) then title else title end end as title from minutes_b where kept", *_PAGE_B))
def guide_b_scan(spark, sf_dir):
    rows = guides.direct_rows(guides.string_rows(_pages_b(spark, sf_dir), "page", "html", "2024-01-15"))
    return rows.select("page", F.col("date").cast("string").alias("date"), "time", "sport", "tournament", F.col("name").alias("title"))


@query(duck("select distinct page, time from minutes_b where ord % 5 = 0", *_PAGE_B))
def guide_b_on_air(spark, sf_dir):
    return guides.on_air_times(_pages_b(spark, sf_dir), "page", "html")


# third-party weeks and calendar cards -------------------------------------------------------
_LIVE_ICON = "is_live_broadcast and ord % 3 = 0"


def _pages_week(spark, sf_dir):
    months = "element_at(array(" + ",".join(q(m) for m in lexicon.MONTHS) + "), month(cast(date as date)))"
    cell = F.expr(f"struct(time, ord, concat('<div class=\"row\"><div class=\"time\">', case when time like '0%' then substr(time, 2) else time end, '</div><div class=\"prname2\">', title, case when ord % 2 = 0 then ' прямая  трансляция' else '' end, case when {_LIVE_ICON} then '<img src=\"/i/ico_live.gif?1\">' when ord % 5 = 1 then '<img src=\"/i/ico_old.gif\">' else '' end, '</div></div>') as x) as r")
    days = bx(spark, sf_dir).select("channel", "date", cell).groupBy("channel", "date").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["x"]), "").alias("body"))
    week = F.date_format(F.date_trunc("week", F.col("date").cast("date")), "yyyy-MM-dd")
    head = F.expr(f"concat('<h3>День, ', day(cast(date as date)), ' ', {months}, '</h3>')")
    return days.withColumn("week", week).groupBy("channel", "week").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", F.concat(head, "body").alias("x")))), lambda r: r["x"]), "").alias("html")).select(F.concat_ws("/", "channel", "week").alias("page"), "week", "html")


# a day of up to 125 rows is within reach of its heading: a row has a clock and a title
@query(duck("select channel || '/' || strftime(date_trunc('week', cast(date as date)), '%Y-%m-%d') as page, date, time, title || case when ord % 2 = 0 then ' прямая трансляция' else '' end as title, ord % 2 = 0 as explicit from (select *, row_number() over (partition by channel, date order by time, ord) as i from bx) where is_live_broadcast and ord % 3 = 0 and 2 * i + 1 <= 250 qualify row_number() over (partition by channel, date, time, lower(title), ord % 2 order by ord) = 1"))
def third_party_week(spark, sf_dir):
    return listings.live_rows(_pages_week(spark, sf_dir), "page", "html", F.col("week").cast("date"))


@query(duck("select channel || '/' || date as page, date, time, title || case when ord % 2 = 0 then ' прямая трансляция' else '' end as title, ord % 2 = 0 as explicit from bx where is_live_broadcast and ord % 3 = 0 qualify row_number() over (partition by channel, date, time, lower(title || case when ord % 2 = 0 then ' прямая трансляция' else '' end) order by ord) = 1"))
def third_party_day(spark, sf_dir):
    """Pages of one day each, without headings: all rows are of the day that was asked for."""
    cell = F.expr(f"struct(time, ord, concat('<div class=\"row\"><div class=\"time\">', case when time like '0%' then substr(time, 2) else time end, '</div><div class=\"prname2\">', title, case when ord % 2 = 0 then ' прямая  трансляция' else '' end, case when {_LIVE_ICON} then '<img src=\"/i/ico_live.gif?1\">' when ord % 5 = 1 then '<img src=\"/i/ico_old.gif\">' else '' end, '</div></div>') as x) as r")
    pages = bx(spark, sf_dir).select("channel", "date", cell).groupBy("channel", "date").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["x"]), "").alias("html"))
    return listings.live_rows(pages.select(F.concat_ws("/", "channel", "date").alias("page"), "html", "date"), "page", "html", F.col("date").cast("date"), week=False)


_CARD_URL = "case ord % 4 when 0 then 'https://x.example/football/_a/match/' when 1 then '/stat/hockey/match/' when 2 then '/other/match/' else '/unknown/match/' end || (ord // 2) || '/'"
_CARD_TIME = "case ord % 3 when 0 then strftime(start_at, '%d.%m.%Y %H:%M') when 1 then strftime(start_at, '%d.%m %H:%M') else strftime(start_at, '%H:%M') end"


@query(
    duck(
        "select url, strftime(start_at + case when start_at < timestamp '2024-02-29 21:00:00' then interval 3 hour else interval 2 hour end, '%Y-%m-%d %H:%M') as start_text, case when url like '%/football/%' then 'Футбол' when url like '%/hockey/%' then 'Хоккей' when url like '/other/%' then 'Прочее' else '' end as sport, title, raw, case ord % 3 when 0 then 'Окончен' when 1 then 'Идёт' else '' end as status from carded qualify row_number() over (partition by date, channel, url order by length(raw) desc, time, ord) = 1",
        f"carded as (select *, {_CARD_URL} as url, {_CARD_TIME} || ' ' || title || case ord % 3 when 0 then ' Окончен' when 1 then ' 2-й тайм' else '' end as raw from bx)",
    )
)
def calendar_cards(spark, sf_dir):
    """Cards of matches, one page a day and channel: clock, link and status."""
    at = F.expr("case ord % 3 when 0 then date_format(start_at, 'dd.MM.yyyy HH:mm') when 1 then date_format(start_at, 'dd.MM HH:mm') else date_format(start_at, 'HH:mm') end")
    url = F.expr(_CARD_URL.replace("//", "div").replace("https:div", "https://"))
    card = F.concat(F.lit('<div class="card"><div>'), at, F.lit('</div><p><a href="'), url, F.lit('#x">'), F.col("title"), F.lit("</a></p>"), F.expr("case ord % 3 when 0 then '<span>Окончен</span>' when 1 then '<span>2-й тайм</span>' else '' end"), F.lit("</div>"))
    pages = bx(spark, sf_dir).select("date", "channel", F.struct("time", "ord", card.alias("x")).alias("r")).groupBy("date", "channel").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["x"]), "").alias("html"))
    got = calendars.match_cards(pages.withColumn("page", F.concat_ws("/", "date", "channel")), "page", "html", F.col("date").cast("date"))
    return got.select("url", F.date_format("start_at", "yyyy-MM-dd HH:mm").alias("start_text"), "sport", "title", F.col("raw_title").alias("raw"), "status")
