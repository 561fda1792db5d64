"""Queries that put scans, contracts, evidence and versions together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import diff, monitor, schedule, texts
from ..sources import guides, shared, store
from . import adapter, basic, guided, joined
from .adapter import DUCK_VERSIONS, NOW, bx, duck
from .basic import BOUNDED, D_USER, STATUS, q, ts

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


# changes of events that stay, channel by channel or, where they have none in common, by their earliest broadcast
_UPDATES = (
    DUCK_VERSIONS,
    "shows as (select 0 as side, ord, title || sport as identity, channel, start_at, slot_end from old union all select 1, ord, title || sport, case when ord % 4 = 0 then 'new ' || channel else channel end, start_at, slot_end from new)",
    "one as (select * from shows qualify row_number() over (partition by side, identity, channel order by start_at, ord) = 1)",
    "o as (select * from one where side = 0)",
    "n as (select * from one where side = 1)",
    "os as (select identity, list_sort(list(channel)) as cs, min(row(start_at, channel, slot_end)) as first from o group by identity)",
    "ns as (select identity, list_sort(list(channel)) as cs, min(row(start_at, channel, slot_end)) as first from n group by identity)",
    "apart as (select identity, os.first as a, ns.first as b from os join ns using (identity) where not list_has_any(os.cs, ns.cs))",
    "common as (select identity, o.channel, o.start_at as s1, n.start_at as s2, o.slot_end as e1, n.slot_end as e2 from o join n using (identity, channel))",
)
_M = lambda x: f"strftime({x}, '%Y-%m-%d %H:%M')"
_FAR = lambda a, b: f"abs(date_diff('second', {a}, {b})) >= 900"


@query(
    duck(
        "select identity, '' as channel, 'channels' as field, array_to_string(os.cs, ',') as \"old\", array_to_string(ns.cs, ',') as \"new\" from os join ns using (identity) where os.cs <> ns.cs "
        f"union all select identity, {q(diff.AIR)}, 'time', {_M('a[1]')}, {_M('b[1]')} from apart where a[1] <> b[1] union all select identity, {q(diff.AIR)}, 'end', {_M('a[3]')}, {_M('b[3]')} from apart where {_FAR('a[3]', 'b[3]')} "
        f"union all select identity, channel, 'time', {_M('s1')}, {_M('s2')} from common where s1 <> s2 union all select identity, channel, 'end', {_M('e1')}, {_M('e2')} from common where {_FAR('e1', 'e2')}",
        *_UPDATES,
    )
)
def channel_updates(spark, sf_dir):
    old, new = adapter.versions(bx(spark, sf_dir))
    new = new.withColumn("channel", F.when(F.col("ord") % 4 == 0, F.concat(F.lit("new "), "channel")).otherwise(F.col("channel")))

    def one(df):
        named = df.select("start_at", "ord", F.concat("title", "sport").alias("identity"), "channel", "slot_end")
        return schedule.first_by(named, [F.col("identity"), F.col("channel")], ["start_at", "ord"]).select("identity", "channel", F.col("start_at").alias("start"), F.col("slot_end").alias("end"))

    return diff.channel_updates(one(old), one(new))


# batches with seeded defects ---------------------------------------------------------------
_CHECKED = (
    f"seeded as (select ord, source, sport, is_live_broadcast, {joined._BAD} from bx)",
    f"checked as (select *, {joined._ERRORS} as errors from seeded)",
    "flagged as (select *, is_live_broadcast and len(list_filter(errors, lambda e: starts_with(e, 'missing:') or starts_with(e, 'format:'))) = 0 as direct from checked)",
)


@query(
    duck(
        "select source, ord, 'error' as level, unnest(errors) as finding from checked union all select source, ord, 'warning', 'live_event_without_sport' from flagged where direct and trim(coalesce(sport, '')) = '' union all select source, ord, 'warning', 'live_event_without_normalized_title' from flagged where direct and trim(coalesce(title, '')) = '' "
        f"union all select source, -1, 'warning', 'duplicate_broadcasts=' || repeats from ({joined.QUERIES['qa_batch'][1]}) where repeats > 0",
        *_CHECKED,
    )
)
def qa_findings(spark, sf_dir):
    seeded = bx(spark, sf_dir).selectExpr("ord", "source", "sport", "is_live_broadcast", *joined._split(joined._BAD))
    return monitor.findings(seeded, ["source"]).withColumn("ord", F.coalesce("ord", F.lit(-1)))


# a provider's rows as events ---------------------------------------------------------------
_RAW = "case ord % 6 when 0 then 'Футбол. ' || tournament || '. ' || title || '. Прямой эфир' when 1 then 'Хоккей: Кубок, ' || title when 2 then 'Теннис  Турнир: ' || title || ' LIVE' when 3 then title when 4 then 'Пляжный волейбол, ' || tournament || '; ' || title else 'Новости спорта' end"


def _epg(spark, sf_dir):
    """Rows as the scan of a provider's pages gives them, with titles of all forms."""
    from ..functions import evidence

    raw = F.expr(_RAW)
    rows = bx(spark, sf_dir).select("ord", "channel", "date", "time", F.col("slot_end").alias("end_at"), text.collapsed(raw).alias("raw_title"))
    return texts.made_once(rows, ["raw_title"], {"claim": evidence.classified(F.col("raw_title"))}).withColumn("live_state", F.col("claim.state"))


_EPG_SQL = "case ord % 6 when 0 then 'Футбол' when 1 then 'Хоккей' when 2 then 'Теннис' when 4 then 'Пляжный волейбол' else '' end as sport, case ord % 6 when 0 then tournament when 1 then 'Кубок' when 2 then 'Турнир' when 4 then tournament || ';' else '' end as tournament, case ord % 6 when 5 then 'Новости спорта' else title end as title, ord % 6 in (0, 2) as is_live, case when ord % 6 in (0, 2) then 'provider_live_text' else 'no_explicit_live_marker' end as method, case ord % 6 when 0 then 'ПРЯМОЙ ЭФИР' when 2 then 'LIVE' else '' end as value"


@query(duck(f"select channel, date, time, {_EPG_SQL} from bx"))
def epg_projected(spark, sf_dir):
    return guides.projected(_epg(spark, sf_dir)).select("channel", "date", "time", "sport", "tournament", "title", "is_live", "method", "value")


@query(duck("select ord, trim(channel) as channel, case when ord % 5 = 0 then trim(raw) else title end as title, case when ord % 7 = 0 and ord % 5 <> 0 then title else trim(raw) end as raw_title, coalesce(flag, ord % 3 = 0) as is_live_broadcast, case when ord % 2 = 0 then 'Europe/Moscow' else 'Asia/Almaty' end as timezone, case when ord % 13 = 0 then 'empty:channel' else '' end as errors from (select ord, case when ord % 13 = 0 then '  ' else channel end as channel, title, '  ' || title || ' raw' as raw, case when ord % 4 <> 1 then is_live_broadcast end as flag from bx)"))
def events_built(spark, sf_dir):
    """Rows of several adapters, with blanks, missing titles and flags, as one contract."""
    rows = bx(spark, sf_dir).select(
        "ord", F.concat(F.lit(" "), "source").alias("source"), F.lit("http://x/").alias("source_url"), F.when(F.col("ord") % 13 == 0, "  ").otherwise(F.concat("channel", F.lit(" "))).alias("channel"), "date", "time", "sport", "tournament",
        F.when(F.col("ord") % 5 != 0, F.col("title")).alias("title"), F.when(F.col("ord") % 7 != 0, F.concat(F.lit("  "), "title", F.lit(" raw"))).otherwise(F.when(F.col("ord") % 5 == 0, F.concat(F.lit("  "), "title", F.lit(" raw")))).alias("raw_title"),
        F.when(F.col("ord") % 4 != 1, F.col("is_live_broadcast")).alias("is_live_broadcast"), (F.col("ord") % 3 == 0).alias("is_live"), F.when(F.col("ord") % 2 == 0, " Europe/Moscow").otherwise(" ").alias("timezone"),
    )
    return monitor.built(rows).select("ord", "channel", "title", "raw_title", "is_live_broadcast", "timezone", F.array_join("errors", ",").alias("errors"))


# guides with their dates and errors ---------------------------------------------------------
_UNDATED = "substr(page, 1, 4) in ('ch03', 'ch07')"


def _titled(spark, sf_dir):
    """Pages of the guide of links whose title states the day, but for two channels'."""
    pages = guided._pages_a(spark, sf_dir)
    day = F.date_format(F.substring_index("page", "/", -1).cast("date"), "dd.MM.yyyy")
    return pages.withColumn("html", F.concat(F.lit("<title>Программа "), F.when(~F.expr(_UNDATED), F.concat(F.lit("на "), day)).otherwise("передач"), F.lit("</title>"), "html"))


@query(duck(f"select page, strftime(cast(split_part(page, '/', 2) as date) + cast(am // 1440 as integer), '%Y-%m-%d') as date, time, x as title, '' as error from scanned where not {_UNDATED} union all select distinct page, '', '', '', 'no date in the title' from listed where {_UNDATED}", *guided._PAGE_A))
def guide_a_dated(spark, sf_dir):
    pages = _titled(spark, sf_dir)
    rows = guides.with_banner(guides.anchors(pages, "page", "html"), guides.banner(pages, "page", "html"), "page")
    good, bad = guides.dated(rows, pages, "page", "html")
    none = F.lit("")
    return good.select("page", F.col("date").cast("string").alias("date"), "time", "title", none.alias("error")).unionByName(bad.select("page", none.alias("date"), none.alias("time"), none.alias("title"), "error"))


@query(duck("select distinct page, 'no day labels' as error from minutes_b where substr(page, 1, 4) in ('ch02', 'ch05')", *guided._PAGE_B))
def guide_b_errors(spark, sf_dir):
    """Pages without day labels are errors, not empty days."""
    bare = F.substring("page", 1, 4).isin("ch02", "ch05")
    pages = guided._pages_b(spark, sf_dir).withColumn("html", F.when(bare, F.regexp_replace("html", "<b>[^<]*</b>", "")).otherwise(F.col("html")))
    return guides.without_dates(pages, "page", "html", "2024-01-15")


@query(duck("select g.*, o.time is not null as on_air, 'high' as strength, case when o.time is not null then 2 else 1 end as n_evidence from (" + guided.QUERIES["guide_b_scan"][1] + ") g left join (select distinct page, time from minutes_b where ord % 5 = 0) o using (page, time)", *guided._PAGE_B))
def guide_b_complete(spark, sf_dir):
    got = guides.string_guide(guided._pages_b(spark, sf_dir), "page", "html", "2024-01-15")
    return got.select("page", F.col("date").cast("string").alias("date"), "time", "sport", "tournament", F.col("name").alias("title"), F.col("claims.on_air").alias("on_air"), F.col("claims.strength").alias("strength"), F.size("evidence").alias("n_evidence"))


# what a refresh keeps, guides as one, versions ----------------------------------------------
@query(duck(f"select ord, coalesce(case when not is_live_broadcast then 'not_direct' when not ({D_USER}) then 'non_sport_studio' when date < '{NOW[:10]}' and status <> 'live' then 'past_not_live' end, 'kept') as reason from st", BOUNDED, STATUS))
def refresh_relevant(spark, sf_dir):
    rows = schedule.with_status(bx(spark, sf_dir), NOW).withColumn("is_live", F.col("is_live_broadcast"))
    return rows.select("ord", F.coalesce(schedule.skipped(NOW), F.lit("kept")).alias("reason"))


@query(basic.QUERIES["merge_dedup"][1])
def schedule_merged(spark, sf_dir):
    """Three guides as one schedule."""
    rows = bx(spark, sf_dir)
    return schedule.merged(*(rows.where(F.col("source") == s) for s in ("guide_a", "guide_b", "guide_c"))).select("ord", "source", "channel", "date", "time", "title")


@query(duck("select ord, strftime(start_at, '%Y-%m-%d %H:%M') as start_text from new", DUCK_VERSIONS))
def snapshot_versions(spark, sf_dir):
    """Two snapshots appended one after the other; what is read back is the second."""
    path = shared.folder(spark, "versions")
    for v, rows in enumerate(adapter.versions(bx(spark, sf_dir))):
        store.append(rows.select("ord", "start_at"), path, v)
    return store.latest(spark, path).select("ord", ts("start_at").alias("start_text"))


@query("select user_id as reader, count(*) as seen, case when user_id % 4 = 0 then 0 else 1 end as good from events group by user_id")
def runtime_state(spark, sf_dir):
    """What each reader has seen, as JSON; a broken record is null and stops no other."""
    path = shared.folder(spark, "state")
    seen = adapter.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("reader")).agg(F.count("*").alias("seen"))
    record = F.to_json(F.struct("reader", "seen"))
    broken = F.concat(F.substring(record, 1, 8), F.lit("#"))
    seen.select(record.alias("value")).union(seen.where("reader % 4 = 0").select(broken)).write.text(path)
    read = store.state(spark, path, "reader long, seen long")
    whole = read.where("reader is not null and seen is not null")
    return whole.select("reader", "seen", F.when(F.col("reader") % 4 == 0, 0).otherwise(1).alias("good"))
