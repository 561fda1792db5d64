"""Queries of status, merge, filters, export, text and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock, evidence, lexicon, text
from ..operators import schedule, texts, windows
from .adapter import NOW, bx, duck, table


# DuckDB text of the same expressions -------------------------------------------------------
def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def alternation(words) -> str:
    return q("|".join(text._quoted(w) for w in words))


def d_norm(x: str) -> str:
    t = f"translate(lower(coalesce({x}, '')), {q(lexicon.MATCH_FROM)}, {q(lexicon.MATCH_TO)})"
    t = f"translate(regexp_replace({t}, '\\([^)]*\\)', ' ', 'g'), '–—', '--')"
    t = f"trim(regexp_replace(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}_\\s-]+', ' ', 'g'), '\\s+', ' ', 'g'), ' -')"
    for w, o in lexicon.MATCH_ALIASES.items():
        t = f"regexp_replace({t}, '(^|[^\\p{{L}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{N}}_])', '\\1{o}\\2', 'g')"
    return t


def d_verify(x: str) -> str:
    t = f"translate(lower(coalesce({x}, '')), 'ё', 'е')"
    return f"trim(regexp_replace(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}_\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def d_collapsed(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def d_english(x: str) -> str:
    t = f"coalesce({x}, '')"
    for a, b in sorted(lexicon.ALIASES.items(), key=lambda p: (-len(p[0]), p[0])):
        t = f"regexp_replace({t}, {q(text._quoted(a))}, {q(b)}, 'gi')"
    return d_collapsed(t)


D_TEXT = f"upper({d_collapsed('title')} || ' ' || {d_collapsed('tournament')} || ' ' || {d_collapsed('sport')})"
D_EDITORIAL = f"regexp_matches({D_TEXT}, {alternation(lexicon.EDITORIAL_MARKERS)})"
D_DIRECT = f"(not {D_EDITORIAL} and is_live_broadcast)"
D_DURATION = "case lower(trim(sport)) " + " ".join(f"when {q(k)} then {v}" for k, v in lexicon.DURATIONS.items()) + f" else {lexicon.DEFAULT_DURATION} end"
D_END = f"coalesce(case when slot_end <= start_at then slot_end + interval 1 day else slot_end end, start_at + to_minutes({D_DURATION}))"
D_STATUS = f"case when timestamp '{NOW}' < start_at then 'upcoming' when timestamp '{NOW}' < end_at then 'live' else 'finished' end"
BOUNDED = f"bounded as (select *, {D_END} as end_at, case when slot_end is null then 'duration' else 'slot' end as end_method from bx)"
STATUS = f"st as (select *, {D_STATUS} as status from bounded)"
DEDUP = f"dd as (select * from st qualify row_number() over (partition by date, time, {d_norm('channel')}, {d_norm('title')} order by ord) = 1)"
D_CANDIDATE = f"(not {D_EDITORIAL} and ({D_DIRECT} or trim(sport) <> '' or trim(tournament) <> '' or regexp_matches({D_TEXT}, {alternation(lexicon.SPORT_MARKERS)})))"
D_USER = f"not (regexp_matches(lower(title), {alternation(lexicon.STUDIO_MARKERS)}) and trim(sport) = '' and trim(tournament) = '')"
D_FAILED = f"case when not {D_DIRECT} then 'not_confirmed_direct' when not {D_CANDIDATE} then 'not_sport_candidate' when not ({D_USER}) then 'non_sport_studio' when date < '{NOW[:10]}' and status <> 'live' then 'past_not_on_air' end"
BASE = (BOUNDED, STATUS, DEDUP)
DAY = "2024-01-14"
FMT = "'yyyy-MM-dd HH:mm'"
ts = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
d_ts = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M')"
D_MONTHS = "[" + ",".join(map(q, lexicon.MONTHS)) + "]"
d_dated = lambda c: f"cast(day({c}) as varchar) || ' ' || {D_MONTHS}[month({c})] || ' ' || strftime({c}, '%H:%M')"
D_WINDOW = f"case when cast(start_at as date) = cast(end_at as date) then strftime(start_at,'%H:%M') || '–' || strftime(end_at,'%H:%M') else {d_dated('start_at')} || ' – ' || {d_dated('end_at')} end"

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


@query(duck("select ord, status from st", BOUNDED, STATUS))
def status_at_instant(spark, sf_dir):
    return schedule.with_status(bx(spark, sf_dir), NOW).select("ord", "status")


@query(duck(f"select ord, {d_ts('start_at')} as start_text, {d_ts('end_at')} as end_text, end_method from bounded", BOUNDED))
def scheduled_bounds(spark, sf_dir):
    return schedule.with_status(bx(spark, sf_dir), NOW).select("ord", ts("start_at").alias("start_text"), ts("end_at").alias("end_text"), "end_method")


LIVE_SQL = duck(f"select ord, date, time, channel, sport, tournament, title from dd where {D_FAILED} is null and status = 'live'", *BASE)


@query(LIVE_SQL)
def live_now(spark, sf_dir):
    rows = schedule.visible(bx(spark, sf_dir), NOW).where("status = 'live'")
    return schedule.in_order(rows).select("ord", "date", "time", "channel", "sport", "tournament", "title")


@query(duck(f"select ord, date, time, channel, title from dd where {D_FAILED} is null and status = 'upcoming' order by date, time, channel, ord limit 10", *BASE))
def upcoming_topk(spark, sf_dir):
    return schedule.upcoming(bx(spark, sf_dir), NOW, 10).select("ord", "date", "time", "channel", "title")


@query(duck("select ord, source, channel, date, time, title from dd", *BASE))
def merge_dedup(spark, sf_dir):
    return schedule.dedup(bx(spark, sf_dir)).select("ord", "source", "channel", "date", "time", "title")


@query(duck("select ord, date, time, channel from bx order by date, time, channel, ord"))
def schedule_sorted(spark, sf_dir):
    return schedule.in_order(bx(spark, sf_dir)).select("ord", "date", "time", "channel")


@query(duck("select distinct trim(channel) as channel from bx where trim(channel) <> ''"))
def unique_channels(spark, sf_dir):
    return bx(spark, sf_dir).select(F.btrim("channel").alias("channel")).where("channel <> ''").distinct().orderBy("channel")


@query(duck(f"select ord from bx where {D_USER}"))
def user_event_filter(spark, sf_dir):
    return bx(spark, sf_dir).where(evidence.is_user_event(F.col("title"), F.col("sport"), F.col("tournament"))).select("ord")


@query(duck(f"select ord, channel from bx where {D_DIRECT}"))
def direct_filter(spark, sf_dir):
    return bx(spark, sf_dir).where(schedule.direct()).select("ord", "channel")


@query(duck(f"select ord, status from dd where date = '{DAY}' and {D_DIRECT} and {D_CANDIDATE} and {D_USER}", *BASE))
def day_selector(spark, sf_dir):
    return schedule.visible(bx(spark, sf_dir), NOW, DAY).select("ord", "status")


@query(duck(f"select ord, date, status from dd where {D_FAILED} is null", *BASE))
def overnight_retention(spark, sf_dir):
    return schedule.visible(bx(spark, sf_dir), NOW).select("ord", "date", "status")


@query(duck(f"select coalesce({D_FAILED}, 'shown') as reason, count(*) as n from dd group by 1", *BASE))
def skip_reason_counts(spark, sf_dir):
    rows = schedule.with_status(schedule.dedup(bx(spark, sf_dir)), NOW)
    return rows.groupBy(F.coalesce(schedule.first_failed(NOW), F.lit("shown")).alias("reason")).agg(F.count("*").alias("n"))


@query(duck(f"select ord, strftime(start_at,'%d.%m.%Y') as start_date, strftime(start_at,'%H:%M') as start_time, strftime(end_at,'%d.%m.%Y') as end_date, strftime(end_at,'%H:%M') as end_time, upper(status) as status, channel, sport, tournament, title, source, case when {D_DIRECT} then 'Yes' else 'No' end as direct, {D_WINDOW} as \"window\" from st", BOUNDED, STATUS))
def export_rows(spark, sf_dir):
    return schedule.export_rows(schedule.with_status(bx(spark, sf_dir), NOW))


@query(duck("select ord, status, channel from st where status in ('finished', 'upcoming')", BOUNDED, STATUS))
def export_mode_split(spark, sf_dir):
    return schedule.export_rows(schedule.with_status(bx(spark, sf_dir), NOW), "finished_upcoming").select("ord", F.lower("status").alias("status"), "channel")


_COUNTS = f"count(*) as total, count(*) filter (where status = 'live') as live, count(*) filter (where status = 'upcoming') as upcoming, count(*) filter (where status = 'finished') as finished, count(*) filter (where {D_DIRECT}) as direct"


@query(duck(f"select case when grouping(channel) = 0 then 'channel' when grouping(source) = 0 then 'source' else 'all' end as level, coalesce(channel, source, '') as name, {_COUNTS} from st group by grouping sets ((channel), (source), ())", BOUNDED, STATUS))
def export_summary_gsets(spark, sf_dir):
    return schedule.summary(schedule.with_status(bx(spark, sf_dir), NOW))


@query(duck("select cast(day as varchar) as day from (select unnest(generate_series(date '2024-01-15', greatest(cast(max(date) as date), date '2024-01-15'), interval 1 day))::date as day from bx)"))
def horizon_dates(spark, sf_dir):
    return schedule.horizon(bx(spark, sf_dir), NOW[:10]).select(F.col("day").cast("string").alias("day"))


@query("select source, cast(date '2024-01-15' + cast(k as integer) as varchar) as scope_date from (select source, unnest(range(-1, ahead + 1)) as k from (select event_type as source, count(*) % 15 as ahead from events group by 1))")
def scope_product(spark, sf_dir):
    """Scopes of each type of event, which is read as many days ahead as its count tells."""
    ahead = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg((F.count("*") % 15).cast("int").alias("lookahead"))
    return schedule.scopes(ahead, NOW[:10]).select("source", F.col("scope_date").cast("string").alias("scope_date"))


# text --------------------------------------------------------------------------------------
@query(f"select doc_id, md5({d_norm('text')}) as digest, length({d_norm('text')}) as n from documents")
def norm_match_text(spark, sf_dir):
    t = text.norm_match(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.cast("binary")).alias("digest"), F.length(t).cast("long").alias("n"))


@query(duck(f"select ord, concat_ws('|', date, time, {d_norm('channel')}, {d_norm('title')}) as key from bx"))
def exact_key(spark, sf_dir):
    return bx(spark, sf_dir).select("ord", text.exact_key(F.col("date"), F.col("time"), F.col("channel"), F.col("title")).alias("key"))


@query(duck(f"select ord, sha1(concat_ws('|', {d_norm('sport')}, {d_norm('tournament')}, {d_norm('title')}))[1:16] as identity from bx"))
def stable_identity(spark, sf_dir):
    return bx(spark, sf_dir).select("ord", text.identity(F.col("sport"), F.col("tournament"), F.col("title")).alias("identity"))


@query(duck("select ord, sha1(concat_ws('|', source, date, date, time, channel, title))[1:24] as storage_id from bx"))
def storage_id(spark, sf_dir):
    return bx(spark, sf_dir).select("ord", text.storage_id(*map(F.col, ("source", "date", "date", "time", "channel", "title"))).alias("storage_id"))


_SHOWN = "case ord % 8 when 0 then title when 1 then 'ШАХТЕР 2010 – ОРДАБАСЫ ' || cast(ord % 100 as {string}) when 2 then 'Қайрат – ТОБЫЛ' when 3 then 'Футбол.  УЕФА Чемпиондар Лигасы. Жалпы кезең. ' || cast(ord % 9 as {string}) || ' тур' when 4 then 'Хоккей. Фонбет Чемпионат кхл. \"СИБИРЬ\" - \"АВТОМОБИЛИСТ\"' when 5 then 'Иртыш–ОҚЖЕТПЕС, ХАН-ТЕНГИРИ (KHL, Uefa), САНКТ-ПЕТЕРБУРГ' when 6 then upper(title) || ' GRAND SLAM f1, формула 1' else 'тобыл-2 и тобыл, ЕРТИС' end"


def d_display(x: str) -> str:
    t = f"trim(regexp_replace(replace({x}, chr(160), ' '), '\\s+', ' ', 'g'))"
    for a, b in lexicon.DISPLAY_PHRASES:
        t = f"regexp_replace({t}, {q(text._quoted(a))}, {q(b)}, 'gi')"
    names = " ".join(f"when {q(a)} then {q(b)}" for a, b in lexicon.DISPLAY_NAMES.items())
    t = f"array_to_string(list_transform(regexp_extract_all(translate({t}, {q(lexicon.KAZAKH_LETTERS)}, {q(lexicon.RUSSIAN_LETTERS)}), '[\\p{{L}}\\p{{N}}_-]+|[^\\p{{L}}\\p{{N}}_-]+'), lambda w: case lower(w) {names} else w end), '')"
    kept = "(" + ", ".join(map(q, lexicon.KEPT_UPPER)) + ")"
    t = f"array_to_string(list_transform(regexp_extract_all({t}, '[A-Za-zА-Яа-яЁё]+(?:-[A-Za-zА-Яа-яЁё]+)*|[^A-Za-zА-Яа-яЁё]+'), lambda w: case when upper(w) in {kept} then upper(w) when regexp_matches(w, '^[A-Za-zА-Яа-яЁё]') and w = upper(w) and length(replace(w, '-', '')) >= 2 then w[1:1] || lower(w[2:]) else w end), '')"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({t}, '\\s+[–—-]\\s+', ' – ', 'g'), '([\\p{{L}}\\p{{N}}_])[–—]([\\p{{L}}\\p{{N}}_])', '\\1 – \\2', 'g'), '\\s+', ' ', 'g'))"


@query(duck(f"select ord, {d_display(_SHOWN.format(string='varchar'))} as shown from bx"))
def display_text(spark, sf_dir):
    rows = bx(spark, sf_dir).select("ord", F.expr(_SHOWN.format(string="string")).alias("said"))
    return texts.made_once(rows, ["said"], {"shown": text.display(F.col("said"))}).select("ord", "shown")


@query(duck("select ord, coalesce(nullif(case when ord % 3 = 0 then '' else title end, ''), nullif(tournament, ''), nullif(sport, ''), '') as picked from bx"))
def title_pick(spark, sf_dir):
    return bx(spark, sf_dir).select("ord", text.title_of(F.when(F.col("ord") % 3 == 0, "").otherwise(F.col("title")), F.col("tournament"), F.col("sport")).alias("picked"))


_SAID = "title || case ord % 7 when 0 then ' LIVE' when 1 then '. Прямой эфир' when 2 then ' (повтор)' when 3 then ' Liverpool' when 4 then ' /live' when 5 then ' Обзор' else '' end"
_FIRST = lambda x, words: "coalesce(" + ",".join(f"case when contains({x}, {q(w)}) then {q(w)} end" for w in words) + ")"


@query(
    duck(
        "select ord, case when replay is not null then 'not_live' when phrase is not null or word then 'live' else 'unknown' end as state, coalesce(replay, phrase, case when word then 'LIVE' else '' end) as value from said",
        f"sayings as (select ord, upper({d_collapsed(_SAID)}) as t from bx)",
        f"said as (select ord, {_FIRST('t', lexicon.REPLAY_MARKERS)} as replay, {_FIRST('t', lexicon.LIVE_MARKERS[:-1])} as phrase, contains(' ' || translate(t, '/-', '  ') || ' ', ' LIVE ') as word from sayings)",
    )
)
def marker_classify(spark, sf_dir):
    said = bx(spark, sf_dir).select("ord", F.expr(_SAID).alias("said"))
    return said.select("ord", evidence.classified(F.col("said")).alias("e")).select("ord", "e.state", "e.value")


@query(duck(f"select ord, regexp_matches(upper({d_collapsed(_SAID)}), {alternation(lexicon.EDITORIAL_MARKERS)}) as editorial from bx"))
def editorial_flag(spark, sf_dir):
    said = bx(spark, sf_dir).select("ord", F.expr(_SAID).alias("said"))
    return said.select("ord", evidence.is_editorial(F.col("said")).alias("editorial"))


_HINT_TEXT = "lower(sport || ' ' || tournament || case ord % 5 when 0 then ' UFC 300' when 1 then ' Гран-при' when 2 then ' КХЛ' else '' end)"


@query(duck("select ord, coalesce(" + ",".join(f"case when contains({_HINT_TEXT}, {q(w)}) then {q(v)} end" for w, v in lexicon.SPORT_HINTS) + ", '') as hint from bx"))
def sport_hint(spark, sf_dir):
    return bx(spark, sf_dir).select("ord", text.sport_hint(F.expr(_HINT_TEXT)).alias("hint"))


_PREFIXED = "case ord % 4 when 0 then 'Футбол. ' when 1 then 'ХОККЕЙ ' when 2 then 'Фигурное катание. ' else '' end || title"
_NAMES = sorted(lexicon.SPORT_HEADINGS, key=lambda s: (-len(s), s))
_ANY = "|".join(map(text._quoted, _NAMES))


@query(
    duck(
        f"select ord, case found {' '.join(f'when {q(k)} then {q(v)}' for k, v in lexicon.SPORT_HEADINGS.items())} else '' end as sport, case when found = '' then x else trim(regexp_replace(x, {q(f'^({_ANY})[.\\s]+')}, '', 'i'), ' .') end as rest from found",
        f"prefixed as (select ord, {_PREFIXED} as x from bx)",
        f"found as (select ord, x, lower(regexp_extract(x, {q(f'^({_ANY})[.\\s]')}, 1, 'i')) as found from prefixed)",
    )
)
def sport_prefix(spark, sf_dir):
    rows = bx(spark, sf_dir).select("ord", F.expr(_PREFIXED).alias("x"))
    return rows.select("ord", text.sport_prefix(F.col("x"), lexicon.SPORT_HEADINGS).alias("p")).select("ord", "p.sport", "p.rest")


_GENERIC = "[" + ",".join(map(q, lexicon.GENERIC_WORDS)) + "]"


@query(duck(f"select ord, array_to_string(list_sort(list_distinct(list_filter(string_split({d_verify(d_english('tournament || chr(32) || title'))}, ' '), lambda w: length(w) >= 4 and not list_contains({_GENERIC}, w)))), ' ') as tokens from bx"))
def tokens_significant(spark, sf_dir):
    rows = bx(spark, sf_dir).select("ord", F.concat_ws(" ", "tournament", "title").alias("said"))
    return texts.made_once(rows, ["said"], {"tokens": F.array_join(F.array_sort(text.significant_tokens(F.col("said"))), " ")}).select("ord", "tokens")


_KIND = "case ord % 5 when 0 then 'Жеребьёвка. ' || tournament when 1 then tournament when 2 then title || ' (Женщины)' else title end"


@query(duck(f"select ord, case when regexp_matches(x, '\\S\\s+(?:-|–|—|vs\\.?|v\\.)\\s+\\S') then 'MATCH' when contains({d_verify('x')}, 'жереб') or contains({d_verify(d_english('x'))}, 'draw') then 'DRAW' else 'GENERIC' end as kind from kinds", f"kinds as (select ord, {_KIND} as x from bx)"))
def event_kind(spark, sf_dir):
    return bx(spark, sf_dir).select("ord", text.event_kind(F.expr(_KIND)).alias("kind"))


@query(duck("select ord, trim(regexp_replace(string_split(title, ' – ')[1], '\\s*\\([^)]*\\)', '', 'g')) as home, trim(regexp_replace(string_split(title, ' – ')[2], '\\s*\\([^)]*\\)', '', 'g')) as away from bx"))
def participants(spark, sf_dir):
    p = text.participants(F.col("title"))
    return bx(spark, sf_dir).select("ord", F.get(p, F.lit(0)).alias("home"), F.get(p, F.lit(1)).alias("away"))


@query(duck(f"select distinct title, {d_english('title')} as english from bx"))
def englished_titles(spark, sf_dir):
    return bx(spark, sf_dir).select("title").distinct().select("title", text.englished(F.col("title")).alias("english"))


# windows -----------------------------------------------------------------------------------
_EV = "ev as (select user_id, event_id, ts, event_type, hour(ts) * 60 + minute(ts) as m from events)"


def _listing(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", (F.hour("ts") * 60 + F.minute("ts")).alias("m"))


@query(f"with {_EV}, l as (select *, case when m < lag(m) over (partition by user_id order by event_id) then 1 else 0 end as back from ev) select event_id, cast(sum(back) over (partition by user_id order by event_id rows unbounded preceding) as bigint) as day_offset from l")
def midnight_rollover(spark, sf_dir):
    return windows.rollover(_listing(spark, sf_dir), ["user_id"], "event_id", "m").select("event_id", "day_offset")


@query(duck(f"select ord, {d_ts('lead(start_at) over (partition by source, channel order by start_at, ord)')} as next_start from bx"))
def next_programme_end(spark, sf_dir):
    return windows.next_end(bx(spark, sf_dir), ["source", "channel"], ["start_at", "ord"], "start_at").select("ord", ts("next_start").alias("next_start"))


@query(f"with {_EV}, p as (select *, lag(m) over (partition by user_id order by event_id) as before from ev) select event_id, cast(sum(case when before is not null and ((m = 420 and event_type = 'view') or (before <= 359 and m >= 360)) then 1 else 0 end) over (partition by user_id order by event_id rows unbounded preceding) as bigint) as block from p")
def day_blocks(spark, sf_dir):
    return windows.day_blocks(_listing(spark, sf_dir), ["user_id"], "event_id", "m", F.col("event_type") == "view").select("event_id", "block")


@query(duck(f"select ord, row_number() over (partition by channel, lower({d_collapsed('title')}) order by date, time, ord) > 1 as repeated from bx"))
def repeat_flag(spark, sf_dir):
    return windows.repeats(bx(spark, sf_dir), ["date", "time", "ord"]).select("ord", "repeated")


@query(f"with {_EV} select event_id, coalesce(last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding), -1) as heading from ev")
def forward_fill_heading(spark, sf_dir):
    rows = _listing(spark, sf_dir).withColumn("h", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return windows.filled(rows, ["user_id"], "event_id", "h", "heading").select("event_id", F.coalesce("heading", F.lit(-1)).alias("heading"))


@query(duck("select source, ord, cast(row_number() over (partition by source order by date, time, ord) as integer) as rank from bx qualify rank <= 20"))
def budget_rank(spark, sf_dir):
    return windows.budgeted(bx(spark, sf_dir), ["source"], ["date", "time", "ord"], 20).select("source", "ord", "rank")


# clocks ------------------------------------------------------------------------------------
@query("select event_id, strftime(ts at time zone 'UTC' at time zone 'Asia/Almaty', '%Y-%m-%d %H:%M') as local_start from events")
def utc_to_local(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", ts(clock.local(F.col("ts"))).alias("local_start"))


@query("select o_orderkey, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') as week from orders")
def week_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(clock.week_key(F.to_date("o_orderdate")), "yyyy-MM-dd").alias("week"))


@query(
    "with c as (select event_id, k, (cast(ts as date) + cast(k as integer) + to_minutes(cast(hour(ts) * 60 + minute(ts) - 180 as integer))) at time zone 'UTC' at time zone 'Asia/Almaty' as a, cast(ts as date) as d from events, (select unnest([-1, 0, 1]) as k)) "
    "select event_id, strftime(a, '%Y-%m-%d %H:%M') as aligned from c qualify row_number() over (partition by event_id order by abs(date_diff('day', d, cast(a as date))), abs(k), k) = 1"
)
def clock_alignment(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", ts(clock.aligned(F.to_date("ts"), F.hour("ts") * 60 + F.minute("ts"), F.lit(3), F.to_date("ts"))).alias("aligned"))


@query("with h as (select event_id, cast(user_id % 25 as int) as h, cast(event_id % 63 as int) as m, case event_id % 3 when 0 then 'am' when 1 then 'pm' else '' end as half from events) select event_id, coalesce(case when m between 0 and 59 and half = 'pm' and h between 1 and 12 then (case when h = 12 then 12 else h + 12 end) * 60 + m when m between 0 and 59 and half = 'am' and h between 1 and 12 then (case when h = 12 then 0 else h end) * 60 + m when m between 0 and 59 and half = '' and h between 0 and 23 then h * 60 + m end, -1) as minute_of_day from h")
def clock_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.expr("cast(user_id % 25 as int) as h"), F.expr("cast(event_id % 63 as int) as m"), F.expr("case event_id % 3 when 0 then 'am' when 1 then 'pm' else '' end as half"))
    return e.select("event_id", F.coalesce(clock.hour(F.col("h"), F.col("m"), F.col("half")), F.lit(-1)).alias("minute_of_day"))
