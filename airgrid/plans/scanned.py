"""Queries of scans, stored snapshots and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import diff, schedule
from ..sources import calendars, guides, html, shared, store
from ..streaming import jobs
from . import adapter
from .adapter import DUCK_VERSIONS, bx, duck, recursive, table
from .basic import d_norm, ts

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


# html --------------------------------------------------------------------------------------
@query("select page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">[^<]*</a>', 1)) as href, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1)) as label from pages")
def html_anchors(spark, sf_dir):
    a = html.elements(table(spark, sf_dir, "pages"), "page_id", "html", ("a",))
    return a.select("page_id", F.try_element_at("attrs", F.lit("href")).alias("href"), F.col("text").alias("label"))


@query("select page_id, replace(replace(replace(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as title from pages")
def html_title(spark, sf_dir):
    return html.elements(table(spark, sf_dir, "pages"), "page_id", "html", ("title",)).select("page_id", F.col("text").alias("title"))


@query()
def html_text_nodes(spark, sf_dir):
    return html.text_nodes(table(spark, sf_dir, "pages"), "page_id", "html")


@query()
def html_signature(spark, sf_dir):
    return html.signature(table(spark, sf_dir, "pages"), "page_id", "html")


_BADGE = "case when is_live_broadcast and ord % 3 = 0 then '<span class=\"live\">live</span>' else '' end"


def _markup(spark, sf_dir):
    rows = bx(spark, sf_dir).select("source", "channel", "date", F.struct("time", "ord", F.expr(_BADGE).alias("badge")).alias("r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: F.concat(F.lit("<p>"), r["badge"], F.lit(" "), r["time"], F.lit(" title</p>"))), "")
    return rows.groupBy("source", "channel", "date").agg(body.alias("html"))


@query(duck("select source, channel, date, array_to_string(list_sort(list_distinct(list(time) filter (where is_live_broadcast and ord % 3 = 0))), ',') as times from bx group by all having times is not null and times <> ''"))
def html_live_gap(spark, sf_dir):
    return _markup(spark, sf_dir).select("source", "channel", "date", F.array_join(guides.gap_live_times(F.col("html")), ",").alias("times")).where("times <> ''")


@query(duck("select source, channel, date, array_to_string(list_sort(list_distinct(list(time) filter (where is_live_broadcast and ord % 3 = 0))), ',') as times from bx group by all having times is not null and times <> ''"))
def page_live_times(spark, sf_dir):
    """Pages of plain text, one a guide, channel and day."""
    said = F.when(F.expr("is_live_broadcast and ord % 3 = 0"), F.concat(F.lit("Live  "), "time")).otherwise(F.concat(F.lit("Alive "), "time"))
    rows = bx(spark, sf_dir).groupBy("source", "channel", "date").agg(F.array_join(F.collect_list(said), " ").alias("said"))
    return rows.select("source", "channel", "date", F.array_join(guides.live_times(F.col("said")), ",").alias("times")).where("times <> ''")


# json and calendar text --------------------------------------------------------------------
@query(duck("select channel, date, time, strftime(coalesce(slot_end, start_at + interval 2 hour), '%Y-%m-%d %H:%M') as end_text, title, case when ord % 5 = 0 then 'live' else 'unknown' end as live_state from bx qualify row_number() over (partition by channel, date, time, title order by ord) = 1"))
def epg_scan(spark, sf_dir):
    iso = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    said = F.when(F.col("ord") % 5 == 0, "Прямой эфир").otherwise("")
    event = F.struct("ord", F.struct(F.concat(F.lit(" "), F.col("title")).alias("title"), said.alias("eventDescriptionMedium"), F.struct(iso("start_at").alias("begin"), iso(F.coalesce("slot_end", F.col("start_at") + F.expr("interval 2 hours"))).alias("end")).alias("scheduledFor")).alias("e"))
    rows = bx(spark, sf_dir).groupBy("channel", "date").agg(F.transform(F.array_sort(F.collect_list(event), lambda a, b: F.when(a["ord"] < b["ord"], -1).otherwise(1)), lambda x: x["e"]).alias("events"))
    landed = rows.select("channel", "date", F.to_json(F.struct(F.array(F.struct("events")).alias("pages"))).alias("body"))
    return guides.epg_rows(landed).select("channel", "date", "time", ts("end_at").alias("end_text"), F.col("raw_title").alias("title"), "live_state")


@query(duck("select date || '/' || channel as page, strftime(start_at at time zone 'Europe/Moscow' at time zone 'Asia/Almaty', '%Y-%m-%d %H:%M') as start_text, sport, tournament, title, status from ev", "lines as (select ord, date, channel, time, case sport when 'Бокс' then 'MMA' else sport end as sport, case when sport = '' then '' else tournament end as tournament, title, start_at, case ord % 3 when 0 then 'Не начался' when 1 then 'Окончен' else '' end as status from bx)", "ev as (select * from lines where status <> '' qualify row_number() over (partition by date, channel, start_at, sport, lower(title) order by tournament, ord) = 1)"))
def calendar_text_scan(spark, sf_dir):
    rows = bx(spark, sf_dir)
    status = F.expr("case ord % 3 when 0 then ' Не начался' when 1 then ' Окончен' else '' end")
    line = F.concat(F.lit("* "), F.col("time"), F.lit(" **"), F.col("title"), F.lit("**"), status)
    first = F.row_number().over(schedule_window("date", "channel", "sport", "tournament")) == 1
    new_sport = F.row_number().over(schedule_window("date", "channel", "sport")) == 1
    said = rows.withColumns({"line": line, "t": first, "s": new_sport})
    full = F.concat(F.when(F.expr("s and sport <> ''"), F.concat(F.lit("## "), F.col("sport"), F.lit("\n"))).otherwise(""), F.when(F.col("t"), F.concat("tournament", F.lit("\n"))).otherwise(""), "line")
    pages = said.groupBy("date", "channel").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sport", "tournament", "ord", full.alias("x")))), lambda x: x["x"]), "\n").alias("body"))
    got = calendars.calendar_rows(pages.withColumn("page", F.concat_ws("/", "date", "channel")), "page", "body", F.col("date").cast("date"))
    return got.select("page", ts("start_at").alias("start_text"), "sport", "tournament", "title", "status")


def schedule_window(*keys):
    from pyspark.sql import Window

    order = [c for c in ("sport", "tournament", "ord") if c not in keys]
    return Window.partitionBy(*keys).orderBy(*order)


# stored snapshots --------------------------------------------------------------------------
def _stored(df):
    return df.select("ord", "source", F.col("date").alias("scope_date"), text.storage_id(*map(F.col, ("source", "date", "date", "time", "channel", "title"))).alias("storage_id"))


_SID = "sha1(concat_ws('|', source, date, date, time, channel, title))[1:24]"
_OLD_NEW = (
    DUCK_VERSIONS.replace("new as (select * replace (case when ord % 13 = 0 then start_at + interval 20 minute else start_at end as start_at) from bx where ord % 11 <> 0)", "new as (select * from bx where ord % 11 <> 0)"),
    f"os as (select distinct {_SID} as sid, source, date from old)",
    f"ns as (select distinct {_SID} as sid, source, date from new)",
)


def _upserted(spark, sf_dir):
    rows = bx(spark, sf_dir)
    before = _stored(rows.where("ord % 7 <> 0")).select("storage_id", "source", "scope_date").distinct().withColumns({"first_seen": F.lit("2024-02-01"), "last_seen": F.lit("2024-02-01"), "run": F.lit("r1")})
    return store.upserted(before, _stored(rows.where("ord % 11 <> 0")), "r2", "2024-02-02")


@query(duck("select coalesce(n.sid, o.sid) as storage_id, coalesce(n.source, o.source) as source, coalesce(n.date, o.date) as scope_date, case when o.sid is null then '2024-02-02' else '2024-02-01' end as first_seen, case when n.sid is null then '2024-02-01' else '2024-02-02' end as last_seen, case when n.sid is null then 'r1' else 'r2' end as run, n.sid is not null as active from os o full join ns n on o.sid = n.sid", *_OLD_NEW))
def upsert_snapshot(spark, sf_dir):
    return _upserted(spark, sf_dir)


@query(duck("select source, date as scope_date, count(*) as n from ns group by all", *_OLD_NEW))
def active_event_counts(spark, sf_dir):
    return store.active_counts(_upserted(spark, sf_dir))


@query(duck("select ord, source, date, coalesce(day(cast(date as date)) % 5 = 0, false) as fallback from bx where case when day(cast(date as date)) % 5 = 0 then ord % 7 <> 0 else ord % 11 <> 0 end"))
def last_good_fallback(spark, sf_dir):
    rows = bx(spark, sf_dir).select("ord", "source", F.col("date").alias("scope_date"))
    verdicts = rows.select("source", "scope_date").distinct().withColumn("status", F.when(F.dayofmonth(F.col("scope_date").cast("date")) % 5 == 0, "blocked").otherwise("ok"))
    return store.published(rows.where("ord % 11 <> 0"), rows.where("ord % 7 <> 0"), verdicts).select("ord", "source", F.col("scope_date").alias("date"), "fallback")


_PACKED = (
    "lined as (select source, date, row_number() over (partition by source, date order by ord) as i, length(concat_ws(' ', time, channel, title)) as n from bx)",
    "folded as (select source, date, i, 0 as message, n as open_n from lined where i = 1 union all select l.source, l.date, l.i, case when f.open_n + 2 + l.n <= 300 then f.message else f.message + 1 end, case when f.open_n + 2 + l.n <= 300 then f.open_n + 2 + l.n else l.n end from folded f join lined l on l.source = f.source and l.date = f.date and l.i = f.i + 1)",
)


@query(recursive("select source, date, message, max(open_n) as n_chars from folded group by all", *_PACKED))
def message_packing(spark, sf_dir):
    rows = bx(spark, sf_dir).select("source", "date", "ord", F.concat_ws(" ", "time", "channel", "title").alias("text"))
    return schedule.packed(rows, ["source", "date"], 300).select("source", "date", "message", F.length("body").alias("n_chars"))


_VIEWED = (
    "heads as (select date, '📅 ' || date as header, chr(10) || chr(10) || '🔴 LIVE · 🟡 SOON · ⚪ OVER' as footer from (select distinct date from bx union all select '2024-03-01'))",
    "blocked as (select date, row_number() over (partition by date order by ord) as i, length(concat_ws(' ', time, title, channel)) as n from bx)",
    "viewed as (select h.date, b.i, 0 as message, length(header) + 2 + b.n as open_n from heads h join blocked b on b.date = h.date and b.i = 1 union all select h.date, b.i, case when v.open_n + 2 + b.n > 300 then v.message + 1 else v.message end, case when v.open_n + 2 + b.n > 300 then length(h.header) + 2 + b.n else v.open_n + 2 + b.n end from viewed v join blocked b on b.date = v.date and b.i = v.i + 1 join heads h on h.date = v.date)",
    "filled as (select date, message, max(open_n) as n from viewed group by all)",
)


@query(recursive("select date, message, n + case when message = (select max(message) from filled g where g.date = f.date) and n + length(footer) <= 300 then length(footer) else 0 end as n_chars from filled f join heads using (date) union all select date, 0, length(header) + 2 + length('Событий нет.') + length(footer) from heads where date not in (select date from blocked)", *_VIEWED))
def view_messages(spark, sf_dir):
    """A view for each day, and one for a day without rows."""
    rows = bx(spark, sf_dir)
    days = rows.select("date").distinct().union(spark.createDataFrame([("2024-03-01",)], "date string"))
    heads = days.select("date", F.concat(F.lit("📅 "), "date").alias("header"), F.lit("\n\n🔴 LIVE · 🟡 SOON · ⚪ OVER").alias("footer"))
    blocks = rows.select("date", "ord", F.concat_ws(" ", "time", "title", "channel").alias("text"))
    return schedule.views(heads, blocks, ["date"], 300).select("date", "message", F.length("body").alias("n_chars"))


# streams -----------------------------------------------------------------------------------
def _events(spark, sf_dir):
    return jobs.landed(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema)


@query("select event_type, count(*) as n from events group by event_type")
def stream_status_counts(spark, sf_dir):
    return jobs.run_once(jobs.status_counts(_events(spark, sf_dir)), shared.folder(spark, "counts"), "complete")


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as hour, event_type, count(*) as n from events group by all")
def stream_windowed_counts(spark, sf_dir):
    out = jobs.run_once(jobs.windowed_counts(_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))), shared.folder(spark, "windows"), "complete")
    return out.select(ts("hour").alias("hour"), "event_type", "n")


_SEEN = (
    "seen as (select user_id, event_id, case when event_id % 7 < 4 then 'a' when event_id % 7 = 4 then 'b' else 'c' end as s, row_number() over (partition by user_id order by event_id) as i from events)",
    "told as (select user_id, i, event_id, s as stable, '' as candidate, 0 as times, true as served from seen where i = 1 union all "
    "select n.user_id, n.i, n.event_id, case when n.s <> t.stable and n.s = t.candidate and t.times + 1 >= 2 then n.s else t.stable end, "
    "case when n.s = t.stable or (n.s = t.candidate and t.times + 1 >= 2) then '' else n.s end, case when n.s = t.stable or (n.s = t.candidate and t.times + 1 >= 2) then 0 when n.s = t.candidate then t.times + 1 else 1 end, "
    "n.s = t.stable or (n.s = t.candidate and t.times + 1 >= 2) from told t join seen n on n.user_id = t.user_id and n.i = t.i + 1)",
)


@query("with recursive " + ",\n".join(_SEEN) + " select cast(user_id as varchar) as source, event_id as ord, stable, served from told")
def stream_debounce(spark, sf_dir):
    """Every user's observations, a thing of two or three signatures."""
    seen = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 7 < 4, "a").when(F.col("event_id") % 7 == 4, "b").otherwise("c").alias("signature"))
    return jobs.debounced(seen, shared.folder(spark, "debounce"))


def _loads(spark, sf_dir):
    """Two loads of the same guide, with some rows missing from either."""
    rows = bx(spark, sf_dir)
    place = F.concat_ws(" ", "date", "time", F.lpad(F.col("ord").cast("string"), 12, "0"))
    part = lambda n, keep: rows.where(keep).select(F.lit(n).cast("long").alias("load"), place.alias("place"), "ord", "channel", "title")
    return part(1, "ord % 7 <> 0"), part(2, "ord % 11 <> 0")


@query(duck("select load, ord, row_number() over (partition by load, channel, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) order by date, time, ord) > 1 as repeated from (select 1 as load, * from bx where ord % 7 <> 0 union all select 2, * from bx where ord % 11 <> 0)"))
def stream_replay_flag(spark, sf_dir):
    """Repeats within each load, told by a stream that is stopped and started again between the loads."""
    folder = shared.folder(spark, "replays")
    for load in _loads(spark, sf_dir):
        load.write.mode("append").parquet(f"{folder}/landing")
        landing = spark.readStream.schema(load.schema).parquet(f"{folder}/landing")
        flags = jobs.run_once(jobs.replay_flags(landing), f"{folder}/out")
    return flags.select("load", "ord", "repeated")


_REFRESH = duck(
    "select storage_id, change from (select coalesce(n.sid, o.sid) as storage_id, case when o.sid is null then 'added' when n.sid is null then 'removed' end as change from os o full join ns n on o.sid = n.sid) where change is not null",
    *_OLD_NEW,
)


@query(_REFRESH)
def stream_refresh_diff(spark, sf_dir):
    folder = shared.folder(spark, "refresh")
    rows = bx(spark, sf_dir)
    for v, part in ((1, rows.where("ord % 7 <> 0")), (2, rows.where("ord % 11 <> 0"))):
        _stored(part).select("storage_id").distinct().withColumn("version", F.lit(v)).write.parquet(f"{folder}/landing/v{v}")
    landing = spark.readStream.schema("storage_id string, version int").parquet(f"{folder}/landing/*")

    def diff(old, new):
        j = old.withColumn("o", F.lit(1)).join(new.withColumn("n", F.lit(1)), "storage_id", "full")
        return j.select("storage_id", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").alias("change")).where("change is not null")

    return jobs.refresh(landing, f"{folder}/out", diff).select("storage_id", "change")


# a guide that changes, slips by a day on one channel, and changes again
_ID = f"sha1(concat_ws('|', {d_norm('sport')}, {d_norm('tournament')}, {d_norm('title')}))[1:16]"
_VERSIONS = (
    DUCK_VERSIONS,
    f"v1 as (select identity, channel, start_at as s, slot_end as e from (select *, {_ID} as identity from old) qualify row_number() over (partition by identity, channel order by start_at, ord) = 1)",
    f"v2 as (select identity, channel, start_at as s, slot_end as e from (select *, {_ID} as identity from new) qualify row_number() over (partition by identity, channel order by start_at, ord) = 1)",
    "v3 as (select identity, channel, s + case when channel = 'ch01' then interval 1 day else interval 0 day end as s, e + case when channel = 'ch01' then interval 1 day else interval 0 day end as e from v2)",
    "v4 as (select * from v3 where left(identity, 1) <> '0')",
    "steps as (select 2 as version, coalesce(o.identity, n.identity) as identity, coalesce(o.channel, n.channel) as channel, o.identity is null as fresh, n.identity is null as gone, o.s as os, n.s as ns, o.e as oe, n.e as ne from v1 o full join v2 n on o.identity = n.identity and o.channel = n.channel union all select 4, o.identity, o.channel, false, true, o.s, null, o.e, null from v3 o where left(o.identity, 1) = '0')",
)


@query(duck("select version, identity, channel, field from (select version, identity, channel, unnest(list_filter([case when fresh then 'channel_added' end, case when gone then 'channel_removed' end, case when os <> ns then 'time' end, case when not fresh and not gone and abs(date_diff('second', oe, ne)) >= 900 then 'end' end], lambda x: x is not null)) as field from steps)", *_VERSIONS))
def stream_refresh_notify(spark, sf_dir):
    """Changes of four snapshots that land one after another; that of one channel by a whole day is suppressed."""
    folder = shared.folder(spark, "notify")
    identity = text.identity(F.col("sport"), F.col("tournament"), F.col("title"))
    old, new = (schedule.first_by(v.select(identity.alias("identity"), "channel", "start_at", "slot_end", "ord"), [F.col("identity"), F.col("channel")], ["start_at", "ord"]).select("identity", "channel", F.col("start_at").alias("start"), F.col("slot_end").alias("end")) for v in adapter.versions(bx(spark, sf_dir)))
    day = F.when(F.col("channel") == "ch01", F.expr("interval 1 day")).otherwise(F.expr("interval 0 day"))
    slipped = new.withColumns({"start": F.col("start") + day, "end": F.col("end") + day})
    for v, rows in enumerate((old, new, slipped, slipped.where("left(identity, 1) <> '0'")), 1):
        rows.withColumn("version", F.lit(v)).write.parquet(f"{folder}/landing/v{v}")
    landing = spark.readStream.schema("identity string, channel string, start timestamp, end timestamp, version int").option("maxFilesPerTrigger", 1000).parquet(f"{folder}/landing/*")
    moved = F.when(F.col("field").isin("time", "end"), (F.unix_timestamp("new", "yyyy-MM-dd HH:mm") - F.unix_timestamp("old", "yyyy-MM-dd HH:mm")) / 60).cast("long")
    slip = lambda found: diff.systemic_changes(found.withColumn("minutes", moved))
    return jobs.refresh(landing, f"{folder}/out", diff.channel_changes, slip).select("version", "identity", "channel", "field")
