"""Queries of reconciliation, simulcasts, snapshots, runs and search results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..operators import diff, monitor, reconcile, schedule, simulcast, verify
from . import adapter
from .adapter import bx, duck, DUCK_CALENDAR, DUCK_RUNS, DUCK_VERSIONS, NOW, recursive, table
from .basic import d_english, d_norm, d_verify, q

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


# reconciliation ----------------------------------------------------------------------------
_SIDE = lambda i: d_verify(f"regexp_replace(string_split(title, ' – ')[{i}], '\\s*\\([^)]*\\)', '', 'g')")
_COMPATIBLE = "(s.sport = '' or c.cal_sport = '' or lower(s.sport) = lower(c.cal_sport))"
_MATCHED = (
    f"wanted as (select distinct title, {_SIDE(1)} as s1, {_SIDE(2)} as s2 from bx)",
    f"had as (select distinct cal_title, {d_verify('cal_title')} as words from cal)",
    "matched as (select title, cal_title from wanted, had where contains(words, s1) and contains(words, s2))",
)


def _reconcile_sql(far: str) -> str:
    return duck(
        "select ord, case when cal_ord is null then 'unknown' when far then 'mismatch' else 'confirmed' end as state, coalesce(cal_ord, -1) as cal_ord, coalesce(difference, 0) as difference from ranked",
        DUCK_CALENDAR,
        *_MATCHED,
        f"diffs as (select s.ord, c.cal_ord, c.difference, {far} as far from bx s left join (select m.title, c.*, 0 as x from matched m join cal c using (cal_title)) j on j.title = s.title and (s.sport = '' or j.cal_sport = '' or s.sport = j.cal_sport), lateral (select j.cal_ord as cal_ord, cast(date_diff('minute', s.start_at, j.cal_start) as bigint) as difference) c)",
        "ranked as (select * from diffs qualify row_number() over (partition by ord order by far, abs(difference), cal_ord) = 1)",
    )


def _slots(spark, sf_dir):
    return bx(spark, sf_dir).select("ord", *reconcile.EVENT, "start_at")


def _reconciled(spark, sf_dir, exact):
    rows = bx(spark, sf_dir)
    cal = adapter.calendar(rows)
    matched = reconcile.mentions(rows.select(*reconcile.EVENT).distinct(), cal.select("cal_title").distinct())
    out = reconcile.by_calendar(_slots(spark, sf_dir), cal, matched, exact)
    return out.select("ord", "state", F.coalesce("cal_ord", F.lit(-1)).alias("cal_ord"), F.coalesce("difference", F.lit(0)).alias("difference"))


@query(_reconcile_sql("not (c.difference between -10 and 45)"))
def calendar_reconcile(spark, sf_dir):
    return _reconciled(spark, sf_dir, False)


@query(_reconcile_sql("c.difference <> 0"))
def calendar_reconcile_exact(spark, sf_dir):
    return _reconciled(spark, sf_dir, True)


@query(duck("select title, cal_title from matched", DUCK_CALENDAR, *_MATCHED))
def calendar_mentions(spark, sf_dir):
    rows = bx(spark, sf_dir)
    return reconcile.mentions(rows.select("title").distinct(), adapter.calendar(rows).select("cal_title").distinct()).select("title", "cal_title")


# titles of all kinds: stages, aliases, transliteration, draws and events without sides; texts that name them, or not
_KINDS = "case ord % 8 when 0 then '1/4 финал. Қайрат – ' || split_part(title, ' – ', 2) when 1 then title when 2 then 'Жеребьёвка' when 3 then 'Дзюдо. ' || split_part(title, ' – ', 1) when 4 then 'Таиланд vs Южная Корея (женщины)' when 5 then 'Кубок' when 6 then 'Өрлеу – Ұлан' else tournament || ' ' || split_part(title, ' – ', 2) end"
_TOURNAMENTS = "case ord % 3 when 0 then 'Лига чемпионов УЕФА' when 1 then tournament else '' end"
_SAID = "case ord % 5 when 0 then 'Kairat against ' || lower(split_part(title, ' – ', 2)) || ', Thailand women beat South Korea' when 1 then 'UEFA Champions League draw, ' || lower(title) when 2 then 'орлеу - улан: judo. ' || split_part(title, ' – ', 1) when 3 then upper(tournament) || ' КУБОК ' || title else 'nothing of this kind' end"
_VARIED = f"varied as (select ord, start_at, {_KINDS} as title, {_TOURNAMENTS} as tournament, sport, {_SAID} as said from bx)"
_STAGE = "trim(regexp_replace(title, '^\\s*(1[/\\\\][24]|¼|½)\\s*финала?\\s*[-:.–—]?\\s*', '', 'i'))"
_TRANSLIT = lambda x: f"translate({x}, {q(lexicon.KAZAKH_LETTERS)}, {q(lexicon.RUSSIAN_LETTERS)})"
_NAME = lambda i: f"trim(regexp_replace(regexp_split_to_array(stage, '\\s+(-|–|—|vs\\.?|v\\.)\\s+')[{i}], '\\s*\\([^)]*\\)', '', 'g'))"
_ALIASES = lambda n: f"list_filter([{d_verify(n)}, {d_verify(_TRANSLIT(n))}, {d_verify(d_english(n))}, {d_verify(d_english(_TRANSLIT(n)))}], lambda x: x <> '')"
_LONG = lambda words, drop, n: f"list_distinct(list_filter(string_split({words}, ' '), lambda w: length(w) >= {n} and not list_contains([{','.join(map(q, drop))}], w)))"
_EXPECTED = "concat_ws(' ', nullif(title, ''), nullif(tournament, ''), nullif(sport, ''))"
_FACTS = (
    _VARIED,
    f"events_text as (select distinct title, tournament, sport, {_STAGE} as stage from varied)",
    f"sided as (select *, len(regexp_split_to_array(stage, '\\s+(-|–|—|vs\\.?|v\\.)\\s+')) = 2 as two, {_NAME(1)} as a, {_NAME(2)} as b, {d_verify(d_english(_EXPECTED))} as expected, {d_verify('tournament')} as t1, {d_verify(d_english('tournament'))} as t2, {d_verify(d_english('title'))} as en from events_text)",
    f"known as (select *, case when two and a <> '' and b <> '' then 'MATCH' when contains({d_verify('title')}, 'жереб') or contains(en, 'draw') then 'DRAW' else 'GENERIC' end as kind, {_ALIASES('a')} as as_a, {_ALIASES('coalesce(b, ' + chr(39) * 2 + ')')} as as_b, {_LONG('expected', lexicon.GENERIC_WORDS, 4)} as telling, list_distinct(list_filter(string_split(expected, ' '), lambda w: length(w) >= 4)) as plain, {_LONG('t2', lexicon.GENERIC_WORDS, 4)} as t_words, list_filter({_LONG('expected', lexicon.STOP_WORDS, 5)}, lambda w: not regexp_full_match(w, '[0-9]+')) as long_words from sided)",
)
_HITS = lambda words, said: f"len(list_filter({words}, lambda w: contains({said}, w)))"
_TOLD = f"case kind when 'MATCH' then {_HITS('as_a', 'ns')} > 0 and {_HITS('as_b', 'ns')} > 0 when 'DRAW' then (contains(ns, 'draw') or contains(ns, 'жереб')) and trim(tournament) <> '' and ((t1 <> '' and contains(ns, t1)) or (t2 <> '' and contains(ns, t2)) or (len(t_words) > 0 and {_HITS('t_words', 'ns')} = len(t_words))) else {_HITS('(case when len(telling) > 0 then telling else plain end)', 'ns')} >= least(2, len(case when len(telling) > 0 then telling else plain end)) and len(case when len(telling) > 0 then telling else plain end) > 0 end"


def _varied(spark, sf_dir):
    return bx(spark, sf_dir).select("ord", "start_at", F.expr(_KINDS).alias("title"), F.expr(_TOURNAMENTS).alias("tournament"), "sport", F.expr(_SAID).alias("said"))


@query(duck(f"select ord, kind, {_TOLD} as told, coalesce({_TOLD}, false) or (length(t2) >= 5 and contains(es, t2)) or (len(long_words) > 0 and {_HITS('long_words', 'es')} >= least(2, len(long_words))) as relaxed from pairs", *_FACTS, f"texts as (select distinct said, {d_verify('said')} as ns, {d_verify(d_english('said'))} as es from varied)", "pairs as (select v.ord, k.*, t.ns, t.es from varied v join known k using (title, tournament, sport) join texts t using (said))"))
def matches_event(spark, sf_dir):
    """Whether a page is about an event, strictly and loosely, over all kinds of titles; distinct pairs of texts are judged once."""
    rows = _varied(spark, sf_dir)
    key = [*reconcile.EVENT, "said"]
    of = [F.col(c) for c in reconcile.EVENT]
    judged = rows.select(*key).distinct().select(*key, text.event_kind(F.col("title")).alias("kind"), verify.matches(F.col("said"), *of).alias("told"), verify.relaxed(F.col("said"), *of).alias("relaxed"))
    return rows.join(judged, key).select("ord", "kind", "told", "relaxed")


@query(
    duck(
        "select ord, case when cal_ord is null then 'unknown' when far then 'mismatch' else 'confirmed' end as state, coalesce(cal_ord, -1) as cal_ord, coalesce(difference, 0) as difference from ranked",
        *_FACTS,
        "cal as (select ord as cal_ord, said as cal_title, sport as cal_sport, start_at + to_minutes(cast((ord * 7) % 90 - 30 as integer)) as cal_start from varied where ord % 3 = 0)",
        f"texts as (select distinct cal_title, {d_verify('cal_title')} as ns from cal)",
        f"matched as (select title, tournament, sport, cal_title from known, texts where {_TOLD})",
        "diffs as (select s.ord, j.cal_ord, cast(date_diff('minute', s.start_at, j.cal_start) as bigint) as difference from varied s left join (select m.title, m.tournament, m.sport as of_sport, c.* from matched m join cal c using (cal_title)) j on j.title = s.title and j.tournament = s.tournament and j.of_sport = s.sport and (s.sport = '' or j.cal_sport = '' or s.sport = j.cal_sport))",
        "ranked as (select *, not (difference between -10 and 45) as far from diffs qualify row_number() over (partition by ord order by not (difference between -10 and 45), abs(difference), cal_ord) = 1)",
    )
)
def calendar_reconcile_texts(spark, sf_dir):
    """Slots of all kinds of titles against a calendar of texts: aliases, draws and events without sides."""
    rows = _varied(spark, sf_dir)
    shift = F.expr("make_dt_interval(0, 0, cast((ord * 7) % 90 - 30 as int), 0)")
    cal = rows.where("ord % 3 = 0").select(F.col("ord").alias("cal_ord"), F.col("said").alias("cal_title"), F.col("sport").alias("cal_sport"), (F.col("start_at") + shift).alias("cal_start"))
    matched = reconcile.mentions(rows.select(*reconcile.EVENT).distinct(), cal.select("cal_title").distinct())
    out = reconcile.by_calendar(rows, cal, matched)
    return out.select("ord", "state", F.coalesce("cal_ord", F.lit(-1)).alias("cal_ord"), F.coalesce("difference", F.lit(0)).alias("difference"))


@query(
    duck(
        f"select s.ord, coalesce(min(t.third_ord), -1) as third_ord, case when min(t.third_ord) is null then 'unknown' else 'third_party_live_unconfirmed' end as badge_state from (select *, {_SIDE(1)} as s1, {_SIDE(2)} as s2 from bx) s left join third t on s.date = t.date and s.channel = t.channel and contains(t.words, s.s1) and contains(t.words, s.s2) group by s.ord",
        f"third as (select ord as third_ord, date, channel, {d_verify(chr(39) + 'LIVE ' + chr(39) + ' || lower(title)')} as words from bx where ord % 4 = 0)",
    )
)
def third_party_evidence(spark, sf_dir):
    rows = bx(spark, sf_dir)
    third = rows.where("ord % 4 = 0").select(F.col("ord").alias("third_ord"), "date", "channel", F.concat(F.lit("LIVE "), F.lower("title")).alias("third_text"))
    return reconcile.third_party(rows, third).select("ord", F.coalesce("third_ord", F.lit(-1)).alias("third_ord"), "badge_state")


@query(duck(f"select ord, case when row_number() over (order by date, time, channel, ord) <= 20 then 'checked' else 'pending' end as turn from bx where start_at between timestamp '{NOW}' - interval 6 hour and timestamp '{NOW}' + interval 36 hour"))
def fallback_budget(spark, sf_dir):
    return reconcile.within_budget(bx(spark, sf_dir), NOW).select("ord", "turn")


_STRICT = ("ch03", "ch05")
_KEY = "concat_ws('|', channel, date, time, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))))"
_STORED_STATE = "case ord % 8 when 1 then 'confirmed' when 5 then 'unknown' else 'unavailable' end"


@query(
    duck(
        "select ord, turn, case when turn = 'checked' then '' when turn = 'cached' then kept else state end as state from turned",
        f"near as ({QUERIES['calendar_reconcile'][1]})",
        f"exact as ({QUERIES['calendar_reconcile_exact'][1]})",
        f"stored as (select key, state, checked_at from (select {_KEY} as key, {_STORED_STATE} as state, timestamp '{NOW}' - to_minutes(cast(ord % 900 as integer)) as checked_at from bx where ord % 4 = 1 or ord % 8 = 2) qualify row_number() over (partition by key order by checked_at desc, state desc) = 1)",
        f"asked as (select b.ord, b.channel, b.date, b.time, b.start_at, {_KEY} as key, case when channel in ('ch03', 'ch05') then e.state else n.state end as state from bx b join near n using (ord) join exact e using (ord) where b.ord % 6 <> 5)",
        f"kept as (select a.*, s.state as kept, case when a.state <> 'unknown' then 'calendar' when channel in ('ch03', 'ch05') then 'strict' when s.state is not null then 'cached' end as first_turn from asked a left join (select * from stored where date_diff('second', checked_at, timestamp '{NOW}') // 60 < case state when 'confirmed' then 720 when 'mismatch' then 720 when 'unknown' then 30 else 5 end) s using (key))",
        f"slow as (select ord, row_number() over (order by date, time, channel, ord) as i from kept where first_turn is null and start_at between timestamp '{NOW}' - interval 6 hour and timestamp '{NOW}' + interval 36 hour)",
        "turned as (select k.*, coalesce(first_turn, case when i <= 20 then 'checked' else 'pending' end) as turn from kept k left join slow using (ord))",
    )
)
def reconcile_driven(spark, sf_dir):
    """Every sport event's way through the calendar, stored verdicts and the budget of slow checks."""
    rows = bx(spark, sf_dir)
    near, exact = calendar_reconcile(spark, sf_dir), calendar_reconcile_exact(spark, sf_dir)
    age = F.expr("make_dt_interval(0, 0, cast(ord % 900 as int), 0)")
    key = reconcile.verdict_key(*map(F.col, ("channel", "date", "time", "title")))
    stored = rows.where("ord % 4 = 1 or ord % 8 = 2").select(key.alias("key"), F.expr(_STORED_STATE).alias("state"), (F.lit(NOW).cast("timestamp") - age).alias("checked_at"))
    out = reconcile.driven(rows.withColumn("is_sport_event", F.expr("ord % 6 <> 5")), near, exact, stored, _STRICT, NOW)
    return out.withColumn("state", F.coalesce("state", F.lit("")))


# simulcasts and snapshots ------------------------------------------------------------------
_KEYED = f"keyed as (select *, {d_norm('title')} as nt, {d_norm('sport')} as ns, {d_norm('tournament')} as nn from bx)"


@query(duck("select a.ord as a, b.ord as b from keyed a join keyed b on a.nt = b.nt and a.nt <> '' and a.ord < b.ord and a.channel <> b.channel and (a.ns = '' or b.ns = '' or a.ns = b.ns) and (a.nn = '' or b.nn = '' or a.nn = b.nn) and abs(date_diff('second', a.start_at, b.start_at)) // 60 <= 30", _KEYED))
def simulcast_pairs(spark, sf_dir):
    return simulcast.pairs(bx(spark, sf_dir))


# first fit: groups are numbered as they are made, and a row joins the first that has a broadcast of the same event in its last half hour
_FIT = (
    f"kb as (select ord, channel, date, time, cast(epoch(start_at) as bigint) as t, {d_norm('title')} as nt, {d_norm('sport')} as ns, {d_norm('tournament')} as nc from bx)",
    "seq as (select *, row_number() over (partition by nt order by date, time, channel, ord) as i from kb where nt <> '')",
    "fit as (select nt, i, ord, ord as group_ord, 1 as g, [{'g': 1, 'name': ord, 'channel': channel, 't': t, 'ns': ns, 'nc': nc}] as held from seq where i = 1 union all "
    "select nt, i, ord, case when hit.g is null then ord else hit.name end, case when hit.g is null then made + 1 else made end, list_append(recent, {'g': coalesce(hit.g, made + 1), 'name': case when hit.g is null then ord else hit.name end, 'channel': channel, 't': t, 'ns': ns, 'nc': nc}) from ("
    "select s.nt, s.i, s.ord, s.channel, s.t, s.ns, s.nc, f.g as made, list_filter(f.held, lambda x: (s.t - x.t) // 60 <= 30) as recent, list_min(list_filter(f.held, lambda x: (s.t - x.t) // 60 <= 30 and x.channel <> s.channel and (s.ns = '' or x.ns = '' or s.ns = x.ns) and (s.nc = '' or x.nc = '' or s.nc = x.nc))) as hit from fit f join seq s on s.nt = f.nt and s.i = f.i + 1))",
    "fitted as (select ord, group_ord from fit union all select ord, ord from kb where nt = '')",
)


@query(recursive("select ord, group_ord from fitted", *_FIT))
def simulcast_groups(spark, sf_dir):
    return simulcast.groups(bx(spark, sf_dir))


@query(recursive("select group_ord, sha1(concat_ws('|', arg_min({0}, k), arg_min({1}, k), arg_min({2}, k)))[1:16] as identity, arg_min(title, k) as title, cast(count(*) as int) as n, strftime(min(start_at), '%Y-%m-%d %H:%M') as first_start from (select *, row(date, time, channel, ord) as k from bx join fitted using (ord)) group by group_ord".format(d_norm("sport"), d_norm("tournament"), d_norm("title")), *_FIT))
def snapshot_build(spark, sf_dir):
    return simulcast.snapshot(bx(spark, sf_dir)).select("group_ord", "identity", "title", F.size("broadcasts").alias("n"), F.date_format(F.get("broadcasts", F.lit(0))["start"], "yyyy-MM-dd HH:mm").alias("first_start"))


_IDENTITY = f"sha1(concat_ws('|', {d_norm('sport')}, {d_norm('tournament')}, {d_norm('title')}))[1:16]"


def _one_each(spark, sf_dir):
    """Two versions with one row for each identity."""
    from ..functions import text

    def one(df):
        named = df.withColumn("identity", text.identity(F.col("sport"), F.col("tournament"), F.col("title")))
        return schedule.first_by(named.select("start_at", "ord", "identity", "channel", "slot_end"), [F.col("identity")], ["start_at", "ord"]).select("identity", "ord", "channel", F.col("start_at").alias("start"), F.col("slot_end").alias("end"))

    old, new = adapter.versions(bx(spark, sf_dir))
    return one(old), one(new)


_ONE_EACH = (
    DUCK_VERSIONS,
    f"o1 as (select *, {_IDENTITY} as identity from old qualify row_number() over (partition by identity order by start_at, ord) = 1)",
    f"n1 as (select *, {_IDENTITY} as identity from new qualify row_number() over (partition by identity order by start_at, ord) = 1)",
    "j1 as (select coalesce(o.identity, n.identity) as identity, o.ord as old_ord, n.ord as new_ord, o.channel as oc, n.channel as nc, o.start_at as os, n.start_at as ns, o.slot_end as oe, n.slot_end as ne from o1 o full join n1 n on o.identity = n.identity)",
    "c1 as (select *, os is distinct from ns as sm, coalesce(abs(date_diff('second', oe, ne)) >= 900, false) as em, oc is distinct from nc as cm from j1)",
)
_KIND = "case when old_ord is null then 'added' when new_ord is null then 'removed' when sm or em or cm then 'updated' else 'same' end"


@query(duck(f"select identity, coalesce(old_ord, -1) as old_ord, coalesce(new_ord, -1) as new_ord, {_KIND} as change, old_ord is not null and new_ord is not null and sm as start_moved, old_ord is not null and new_ord is not null and em as end_moved from c1 where not (new_ord is null and coalesce(oe, os + interval 2 hour) <= timestamp '{NOW}')", *_ONE_EACH))
def snapshot_diff(spark, sf_dir):
    old, new = _one_each(spark, sf_dir)
    p = diff.paired(old.select("identity", "ord", F.unix_timestamp("start").alias("start")), new.select("identity", "ord", F.unix_timestamp("start").alias("start")))
    return diff.changes(old, new, p, NOW).select("identity", F.coalesce("old_ord", F.lit(-1)).alias("old_ord"), F.coalesce("new_ord", F.lit(-1)).alias("new_ord"), "change", "start_moved", "end_moved")


# each old one in order of start takes the nearest new one left; those left are told at the end
_NEAREST = (
    DUCK_VERSIONS,
    f"os as (select {_IDENTITY} as identity, ord, cast(epoch(start_at) as bigint) as s from old)",
    f"ns as (select {_IDENTITY} as identity, list(row(cast(epoch(start_at) as bigint), ord) order by start_at, ord) as news from new group by all)",
    "turns as (select *, row_number() over (partition by identity order by s, ord) as i, count(*) over (partition by identity) as n from os)",
    "taken as (select identity, cast(0 as bigint) as i, cast(null as bigint) as old_ord, cast(null as bigint) as new_ord, coalesce(news, []) as news_left from (select distinct identity from os) left join ns using (identity) union all "
    "select identity, i, ord, best.o, list_filter(news_left, lambda x: x[2] is distinct from best.o) from (select t.identity, u.i, u.ord, t.news_left, list_min(list_transform(t.news_left, lambda x: {'d': abs(x[1] - u.s), 's': x[1], 'o': x[2]})) as best from taken t join turns u on u.identity = t.identity and u.i = t.i + 1))",
)


@query(recursive("select identity, coalesce(old_ord, -1) as old_ord, coalesce(new_ord, -1) as new_ord from (select identity, old_ord, new_ord from taken where i > 0 union all select identity, null, unnest(list_transform(news_left, lambda x: x[2])) from taken t where i = (select count(*) from os where os.identity = t.identity) union all select identity, null, unnest(list_transform(news, lambda x: x[2])) from ns where identity not in (select identity from os))", *_NEAREST))
def snapshot_pairs_greedy(spark, sf_dir):
    from ..functions import text

    named = lambda df: df.select(text.identity(F.col("sport"), F.col("tournament"), F.col("title")).alias("identity"), "ord", F.unix_timestamp("start_at").alias("start"))
    old, new = adapter.versions(bx(spark, sf_dir))
    return diff.paired(named(old), named(new)).select("identity", F.coalesce("old_ord", F.lit(-1)).alias("old_ord"), F.coalesce("new_ord", F.lit(-1)).alias("new_ord"))


@query(
    duck(
        "select identity, channel, unnest([x for x in [case when os is null then {'field': 'channel_added', 'old': null, 'new': channel} end, case when ns is null then {'field': 'channel_removed', 'old': channel, 'new': null} end, case when os <> ns then {'field': 'time', 'old': strftime(os, '%Y-%m-%d %H:%M'), 'new': strftime(ns, '%Y-%m-%d %H:%M')} end, case when os is not null and ns is not null and abs(date_diff('second', oe, ne)) >= 900 then {'field': 'end', 'old': strftime(oe, '%Y-%m-%d %H:%M'), 'new': strftime(ne, '%Y-%m-%d %H:%M')} end] if x is not null], recursive := true) from jc",
        DUCK_VERSIONS,
        f"oc as (select *, {_IDENTITY} as identity from old qualify row_number() over (partition by identity, channel order by start_at, ord) = 1)",
        f"nc as (select *, {_IDENTITY} as identity from new qualify row_number() over (partition by identity, channel order by start_at, ord) = 1)",
        "jc as (select coalesce(o.identity, n.identity) as identity, coalesce(o.channel, n.channel) as channel, o.start_at as os, n.start_at as ns, o.slot_end as oe, n.slot_end as ne from oc o full join nc n on o.identity = n.identity and o.channel = n.channel)",
    )
)
def channel_diff(spark, sf_dir):
    return _channel_diff(*adapter.versions(bx(spark, sf_dir)))


def _channel_diff(old, new):
    def one(df):
        named = df.withColumn("identity", text.identity(F.col("sport"), F.col("tournament"), F.col("title"))).select("start_at", "ord", "identity", "channel", "slot_end")
        return schedule.first_by(named, [F.col("identity"), F.col("channel")], ["start_at", "ord"]).select("identity", "channel", F.col("start_at").alias("start"), F.col("slot_end").alias("end"))

    return diff.channel_changes(one(old), one(new))


# all rows before, and all rows after one channel's guide has slipped by a day
_SLIPPED = QUERIES["channel_diff"][1].replace(DUCK_VERSIONS, "old as (select * from bx), new as (select * replace (case when channel = 'ch01' then start_at + interval 1 day else start_at end as start_at, case when channel = 'ch01' then slot_end + interval 1 day else slot_end end as slot_end) from bx)")
_GUARD = "count(*) filter (where field = 'time') as n, count(distinct identity) as events, bool_and(field in ('time', 'end')) and count(distinct identity) >= 3 and count(*) filter (where field = 'time') = count(distinct identity) and count(distinct channel) = 1 and count(distinct minutes) = 1 and abs(min(minutes)) = 1440 as systemic"


@query(f"select {_GUARD} from (select identity, channel, field, date_diff('minute', strptime(\"old\", '%Y-%m-%d %H:%M'), strptime(\"new\", '%Y-%m-%d %H:%M')) as minutes from ({_SLIPPED}))")
def systemic_shift(spark, sf_dir):
    """The guard over the whole diff of two versions, one channel of which has slipped by a day."""
    slip = lambda c: F.when(F.col("channel") == "ch01", F.col(c) + F.expr("interval 1 day")).otherwise(F.col(c))
    rows = bx(spark, sf_dir)
    moved = _channel_diff(rows, rows.withColumns({"start_at": slip("start_at"), "slot_end": slip("slot_end")}))
    at = lambda c: F.unix_timestamp(c, "yyyy-MM-dd HH:mm")
    return diff.systemic_changes(moved.select("identity", "channel", "field", ((at("new") - at("old")) / 60).cast("long").alias("minutes")))


@query(f"select count(*) as n, count(distinct identity) as events, count(distinct identity) >= 3 and count(*) = count(distinct identity) and count(distinct channel) = 1 and count(distinct minutes) = 1 and abs(min(minutes)) = 1440 as systemic from (select identity, channel, date_diff('minute', strptime(\"old\", '%Y-%m-%d %H:%M'), strptime(\"new\", '%Y-%m-%d %H:%M')) as minutes from ({QUERIES['channel_diff'][1]}) where field = 'time')")
def systemic_shift_whole(spark, sf_dir):
    """The guard over every start moved between the two versions."""
    moved = channel_diff(spark, sf_dir).where("field = 'time'")
    at = lambda c: F.unix_timestamp(c, "yyyy-MM-dd HH:mm")
    return diff.systemic_shift(moved.select("identity", "channel", ((at("new") - at("old")) / 60).cast("long").alias("minutes")))


@query(duck(f"select ord, coalesce(slot_end > timestamp '{NOW}', false) as relevant from bx"))
def expired_suppression(spark, sf_dir):
    return bx(spark, sf_dir).select("ord", diff.still_relevant(F.col("slot_end"), NOW).alias("relevant"))


# runs and checks ---------------------------------------------------------------------------
_BAD = "case when ord % 17 = 0 then null else channel end as channel, case when ord % 19 = 0 then '2024-13-45' else date end as date, case when ord % 23 = 0 then '25:00' else time end as time, case when ord % 29 = 0 then ' ' else title end as title, case when ord % 31 = 0 then start_at else slot_end end as slot_end"
_ERRORS = "list_filter([case when source is null then 'missing:source' end, case when channel is null then 'missing:channel' end, case when date is null then 'missing:date' end, case when time is null then 'missing:time' end, case when title is null then 'missing:title' end, case when trim(channel) = '' then 'empty:channel' end, case when trim(title) = '' then 'empty:title' end, case when try_strptime(date, '%Y-%m-%d') is null then 'format:date' end, case when not regexp_matches(time, '^([01]\\d|2[0-3]):[0-5]\\d$') then 'format:time' end, case when slot_end <= try_strptime(date || ' ' || time, '%Y-%m-%d %H:%M') then 'end:not_after_start' end], lambda x: x is not null)"


def _seeded(spark, sf_dir):
    return bx(spark, sf_dir).selectExpr("ord", "source", *_split(_BAD))


def _split(s: str) -> list[str]:
    return [x.strip() for x in s.split(", case ") for x in ([x] if x.startswith("case") else ["case " + x])]


_SEEDED = f"seeded as (select ord, source, {_BAD} from bx)"


@query(duck(f"select ord, array_to_string({_ERRORS}, ',') as errors from seeded", _SEEDED))
def contract_errors(spark, sf_dir):
    return _seeded(spark, sf_dir).select("ord", F.array_join(monitor.contract_errors(), ",").alias("errors"))


@query(
    duck(
        "select source, count(*) as n, count(*) filter (where bad) as bad, count(*) filter (where not bad) - count(distinct case when not bad then key end) as repeats, count(*) filter (where bad) = 0 as ok from checked group by source",
        _SEEDED,
        f"checked as (select source, len({_ERRORS}) > 0 as bad, concat_ws('|', date, time, {d_norm('channel')}, {d_norm('title')}) as key from seeded)",
    )
)
def qa_batch(spark, sf_dir):
    return monitor.batch_check(_seeded(spark, sf_dir), ["source"])


def _runs_sql(body: str, *more: str) -> str:
    return "with " + ",\n".join([DUCK_RUNS, *more]) + "\n" + body


@query(_runs_sql("select source, arg_max(event_count, seq) as previous from runs where status in ('ok', 'warning') group by source"))
def latest_success(spark, sf_dir):
    return monitor.latest_success(adapter.runs(spark, sf_dir), ["source"])


@query(_runs_sql("select source, seq, scope_date, status, event_count from (select * from runs order by seq desc limit 100) qualify row_number() over (partition by source order by seq desc) = 1"))
def latest_run_per_source(spark, sf_dir):
    return monitor.latest_run(adapter.runs(spark, sf_dir))


_PREVIOUS = "previous as (select *, last_value(case when status in ('ok', 'warning') then event_count end ignore nulls) over (partition by source order by seq rows between unbounded preceding and 1 preceding) as p from runs)"
_ASSESS = "case when status = 'error' then 'error:source_error' when p is null and event_count = 0 then 'warning:first_observation_is_empty' when p is null then 'ok:baseline_created' when p >= 3 and event_count = 0 then 'blocked:event_count_collapsed_to_zero' when p >= 5 and event_count / p <= 0.2 then 'blocked:event_count_drop_over_80_percent' when p >= 10 and event_count / p <= 0.5 then 'warning:event_count_drop_over_50_percent' when p >= 5 and event_count >= p * 3 then 'warning:event_count_increased_over_3x' else 'ok:source_output_looks_normal' end"


def _assessed(spark, sf_dir):
    runs = monitor.before_each(adapter.runs(spark, sf_dir), ["source"])
    return runs.withColumn("verdict", monitor.assessed(F.col("event_count"), F.col("previous"), F.col("status") == "error"))


@query(_runs_sql(f"select source, scope_date, {_ASSESS} as verdict from previous", _PREVIOUS))
def anomaly_assess(spark, sf_dir):
    return _assessed(spark, sf_dir).select("source", "scope_date", F.concat_ws(":", "verdict.status", "verdict.reason").alias("verdict"))


@query(_runs_sql(f"select scope_date, bool_or(v like 'blocked:%' or v like 'error:%') as degraded, coalesce(array_to_string(list_sort(list_distinct(list(regexp_extract(v, ':(.*)', 1)) filter (where v not like 'ok:%'))), ','), '') as reasons from (select scope_date, {_ASSESS} as v from previous) group by scope_date", _PREVIOUS))
def run_rollup(spark, sf_dir):
    return monitor.rollup(_assessed(spark, sf_dir), ["scope_date"])


@query(duck("select d.source, d.channel, coalesce(l.status, 'never') as status, count(b.ord) as n from (select distinct source, channel from bx union all select 'guide_x', 'ch99') d left join last_run l on d.source = l.guide left join bx b on b.source = d.source and b.channel = d.channel and b.date = l.scope_date group by all", DUCK_RUNS, "last_run as (select case source when 'view' then 'guide_a' when 'click' then 'guide_b' when 'signup' then 'guide_c' end as guide, status, scope_date from (select * from runs order by seq desc limit 100) qualify row_number() over (partition by source order by seq desc) = 1)"))
def channel_health(spark, sf_dir):
    rows = bx(spark, sf_dir)
    names = F.create_map(*map(F.lit, ("view", "guide_a", "click", "guide_b", "signup", "guide_c")))
    runs = adapter.runs(spark, sf_dir).withColumn("source", F.coalesce(F.try_element_at(names, F.col("source")), F.col("source")))
    channels = rows.select("source", "channel").distinct().union(spark.createDataFrame([("guide_x", "ch99")], "source string, channel string"))
    return monitor.channel_health(channels, runs, rows)


# search results ----------------------------------------------------------------------------
_HOST = "regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\\.', '')"
_TWO = "(^|\\.)[^.]+\\.(" + "|".join(s.replace(".", "\\.") for s in lexicon.TWO_LEVEL_SUFFIXES) + ")$"
_HOSTS = f"hosts as (select page_id, url, {_HOST} as host from pages)"
_BASE = f"bases as (select *, case when host = '' then 'unknown' when regexp_matches(host, '{_TWO}') then array_to_string(string_split(host, '.')[-3:], '.') else array_to_string(string_split(host, '.')[-2:], '.') end as domain from hosts)"
_IN = lambda xs: "(" + ",".join(map(q, xs)) + ")"
_WEIGHT = f"weights as (select *, case when domain in {_IN(lexicon.OFFICIAL_DOMAINS)} then 100 when domain in {_IN(lexicon.MEDIA_DOMAINS)} then 70 when domain in {_IN(lexicon.DATABASE_DOMAINS)} then 60 when regexp_matches(domain, '{'|'.join(lexicon.BETTING_WORDS)}') then 20 else 40 end as weight from bases)"
_CASES = lambda c, m: f"case {c} " + " ".join(f"when {q(k)} then {v}" for k, v in m.items()) + " end"


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").withColumn("host", verify.host(F.col("url"))).withColumn("domain", verify.base_domain(F.col("host")))


@query(f"with {_HOSTS}, {_BASE} select page_id, host, domain from bases")
def host_base_domain(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "host", "domain")


@query(f"with {_HOSTS}, {_BASE}, {_WEIGHT} select page_id, weight from weights")
def source_weight(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", verify.source_weight(F.col("domain")).alias("weight"))


@query(f"with {_HOSTS}, {_BASE} select page_id, coalesce({_CASES('host', lexicon.DOMAIN_HOURS)}, {_CASES('domain', lexicon.DOMAIN_HOURS)}, {_CASES(chr(39) + chr(39) + ' || string_split(host, ' + chr(39) + '.' + chr(39) + ')[-1]', lexicon.SUFFIX_HOURS)}, -99) as hours from bases")
def zone_by_url(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.coalesce(verify.zone_hours(F.col("host")), F.lit(-99)).alias("hours"))


_RESULTS = "results as (select page_id as ord, url, 'Title ' || page_id % 7 as title from pages union all select page_id + 1000000, upper(url), 'TITLE ' || page_id % 7 from pages where page_id % 3 = 0)"


def _results(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    title = lambda t: F.concat(F.lit(t), (F.col("page_id") % 7).cast("string"))
    return p.select(F.col("page_id").alias("ord"), "url", title("Title ").alias("title")).union(p.where("page_id % 3 = 0").select(F.col("page_id") + 1000000, F.upper("url"), title("TITLE ")))


@query(f"with {_RESULTS} select ord, url from results qualify row_number() over (partition by lower(url), lower(title) order by ord) = 1")
def search_dedup(spark, sf_dir):
    return verify.search_dedup(_results(spark, sf_dir)).select("ord", "url")


@query(f"with {_HOSTS}, {_BASE}, {_WEIGHT} select domain, weight, page_id as ord, url from (select * from weights qualify row_number() over (partition by domain order by weight desc, page_id, url) = 1) order by weight desc, page_id limit 5")
def extraction_select(spark, sf_dir):
    return verify.extraction_choice(table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), "url"))


_CANDIDATES = "candidates as (select user_id, strftime(ts, '%Y-%m-%d') as day, event_id as ord, cast(epoch(date_trunc('minute', ts)) as bigint) as \"at\", event_type as organisation, case event_type when 'view' then 100 when 'click' then 70 when 'signup' then 60 when 'purchase' then 40 else 20 end as weight, event_id % 3 = 0 as explicit, cast(floor(value) as bigint) % 10 as score, cast(event_id % 90 as bigint) - 45 as difference from events)"


def _candidates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.selectExpr("user_id", "date_format(ts, 'yyyy-MM-dd') as day", "event_id as ord", "unix_timestamp(date_trunc('minute', ts)) as at", "event_type as organisation", "case event_type when 'view' then 100 when 'click' then 70 when 'signup' then 60 when 'purchase' then 40 else 20 end as weight", "event_id % 3 = 0 as explicit", "cast(floor(value) as bigint) % 10 as score", "event_id % 90 - 45 as difference")


_CLUSTERS = (
    "times as (select distinct user_id, day, \"at\" from candidates)",
    "numbered as (select *, row_number() over (partition by user_id, day order by \"at\") as i from times)",
    "anchored as (select user_id, day, i, \"at\", \"at\" as cluster from numbered where i = 1 union all select n.user_id, n.day, n.i, n.\"at\", case when n.\"at\" - a.cluster <= 7200 then a.cluster else n.\"at\" end from anchored a join numbered n on n.user_id = a.user_id and n.day = a.day and n.i = a.i + 1)",
)


def _cluster_sql(body: str, *more: str) -> str:
    return "with recursive " + ",\n".join([_CANDIDATES, *_CLUSTERS, *more]) + "\n" + body


@query(_cluster_sql("select c.ord, a.cluster from candidates c join anchored a using (user_id, day, \"at\")"))
def time_clusters(spark, sf_dir):
    return verify.clusters(_candidates(spark, sf_dir), ["user_id", "day"], 7200).select("ord", "cluster")


@query(
    _cluster_sql(
        "select user_id, day, cluster, weight, organisations, members from tally qualify row_number() over (partition by user_id, day order by weight desc, organisations desc, members desc, cluster) = 1",
        "voices as (select user_id, day, a.cluster, organisation, max(weight) as weight, count(*) as n from candidates c join anchored a using (user_id, day, \"at\") group by all)",
        "tally as (select user_id, day, cluster, cast(sum(weight) as bigint) as weight, count(*) as organisations, cast(sum(n) as bigint) as members from voices group by all)",
    )
)
def cluster_vote(spark, sf_dir):
    return verify.vote(verify.clusters(_candidates(spark, sf_dir), ["user_id", "day"], 7200), ["user_id", "day"])


@query(
    "with "
    + _CANDIDATES
    + ", near as (select user_id, day, organisation, max(weight) as weight from candidates where abs(difference) <= 30 group by all), tally as (select user_id, day, max(weight) as top, cast(sum(weight) as bigint) as weight, count(*) as organisations from near group by all) select user_id, day, organisations, weight, top >= 100 or (organisations >= 2 and weight >= 100) as confirmed, case when organisations >= 2 and weight >= 120 then 'high' when organisations >= 2 or weight >= 70 then 'medium' else 'low' end as confidence from tally"
)
def consensus_confirm(spark, sf_dir):
    return verify.consensus(_candidates(spark, sf_dir), ["user_id", "day"])


@query("with " + _CANDIDATES + " select user_id, day, \"at\", explicit, score from candidates qualify row_number() over (partition by user_id, day order by explicit desc, score desc, ord) = 1")
def best_time(spark, sf_dir):
    return verify.best_time(_candidates(spark, sf_dir), ["user_id", "day"])
