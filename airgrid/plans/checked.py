"""Queries of verdicts, incidents, messages and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock, text
from ..operators import monitor, schedule, texts, verify
from ..sources import calendars
from . import adapter, joined
from .adapter import DUCK_RUNS, NOW, bx, duck, table
from .basic import BASE, D_FAILED, d_english, q
from .joined import _ASSESS, _CANDIDATES, _CLUSTERS, _PREVIOUS

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


# verdicts ----------------------------------------------------------------------------------
@query(duck(f"select ord, {d_english('title || chr(32) || tournament || chr(32) || sport || chr(32) || strftime(start_at, ' + q('%B %d %Y') + ')')} as first, {d_english('title || chr(32) || tournament || chr(32) || sport || chr(32) || strftime(start_at, ' + q('%B %d %Y') + ')')} || ' start time schedule' as second from bx"))
def query_strings(spark, sf_dir):
    return verify.query_strings(bx(spark, sf_dir).select("ord", "title", "tournament", "sport", "start_at")).select("ord", "first", "second")


@query("select case when page_id % 3 = 0 then url || '?read' else url end as url, case when page_id % 2 = 0 then 'Page ' || page_id else 'Result ' || page_id end as title, length(html) as n from pages where page_id % 5 <> 0 and length(trim(coalesce(html, ''))) > 0")
def result_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    results = p.select(F.concat(F.col("url"), F.lit("#"), F.col("page_id")).alias("url"), F.concat(F.lit("Result "), F.col("page_id")).alias("title"))
    read = p.select(F.concat(F.col("url"), F.lit("#"), F.col("page_id")).alias("url"), F.expr("case when page_id % 3 = 0 then url || '?read' else url end").alias("page_url"), F.expr("case when page_id % 2 = 0 then 'Page ' || page_id else '' end").alias("page_title"), F.expr("case when page_id % 5 = 0 then ' ' else html end").alias("content"))
    return verify.with_pages(results, read).select("url", "title", F.length("content").cast("long").alias("n"))


@query("with " + _CANDIDATES + " select user_id, day, organisation, ord, score from candidates qualify row_number() over (partition by user_id, day, organisation order by score desc, ord) = 1")
def best_candidates(spark, sf_dir):
    return verify.best_per_key(joined._candidates(spark, sf_dir), ["user_id", "day", "organisation"]).select("user_id", "day", "organisation", "ord", "score")


@query("with " + _CANDIDATES + ", once as (select * from candidates qualify row_number() over (partition by user_id, day, organisation order by weight desc, ord) = 1) select user_id, day, organisation, ord, row_number() over (partition by user_id, day order by weight desc, ord) as place from once")
def unique_sources(spark, sf_dir):
    return verify.unique_sources(joined._candidates(spark, sf_dir), ["user_id", "day"]).select("user_id", "day", "organisation", "ord", "place")


_VERDICT = (
    "voices as (select user_id, day, a.cluster, organisation, max(weight) as weight, count(*) as n from candidates c join anchored a using (user_id, day, \"at\") group by all)",
    "won as (select user_id, day, cluster, cast(sum(weight) as bigint) as weight, count(*) as organisations, sum(n) as members from voices group by user_id, day, cluster qualify row_number() over (partition by user_id, day order by sum(weight) desc, count(*) desc, sum(n) desc, cluster) = 1)",
    "spoken as (select c.user_id, c.day, c.\"at\", w.organisations from candidates c join anchored a using (user_id, day, \"at\") join won w on w.user_id = c.user_id and w.day = c.day and w.cluster = a.cluster qualify row_number() over (partition by c.user_id, c.day order by c.weight desc, c.score desc, c.ord) = 1)",
    "slots as (select u.user_id, d.day, cast(epoch(cast(d.day as timestamp)) as bigint) + (u.user_id % 24) * 3600 as start from (select distinct user_id from events) u, (select distinct strftime(ts, '%Y-%m-%d') as day from events) d)",
)


@query("with recursive " + ",\n".join([_CANDIDATES, *_CLUSTERS, *_VERDICT]) + " select user_id, day, case when \"at\" is null then 'unknown' when abs(cast(trunc((\"at\" - start) / 60) as bigint)) <= 30 then 'verified' else 'rejected' end as state, coalesce(cast(trunc((\"at\" - start) / 60) as bigint), -99999) as difference, coalesce(organisations, 0) as organisations from slots left join spoken using (user_id, day)")
def verify_verdict(spark, sf_dir):
    c = joined._candidates(spark, sf_dir)
    e = table(spark, sf_dir, "events")
    # a slot for every user and every day of the log; on some there is no candidate
    days = e.select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    slots = e.select("user_id").distinct().crossJoin(days).withColumn("start", F.unix_timestamp("day", "yyyy-MM-dd") + (F.col("user_id") % 24) * 3600)
    return verify.verdict(c, slots, ["user_id", "day"], 7200).withColumn("difference", F.coalesce("difference", F.lit(-99999)))


# incidents, runs and scopes ----------------------------------------------------------------
_INCIDENTS = f"found as (select source, scope_date, seq, {_ASSESS} as v from previous)"


@query("with " + ",\n".join([DUCK_RUNS, _PREVIOUS, _INCIDENTS]) + " select source, scope_date, seq, regexp_extract(v, '^([^:]*)', 1) as severity, regexp_extract(v, ':(.*)', 1) as reason from found where v like 'blocked:%' or v like 'error:%'")
def incidents(spark, sf_dir):
    return monitor.incidents(joined._assessed(spark, sf_dir)).drop("resolved_at")


@query("with " + ",\n".join([DUCK_RUNS, _PREVIOUS, _INCIDENTS]) + " select source, scope_date, seq from found where (v like 'blocked:%' or v like 'error:%') and seq % 5 <> 0 order by seq desc, source limit 10")
def unresolved_incidents(spark, sf_dir):
    found = monitor.incidents(joined._assessed(spark, sf_dir)).withColumn("resolved_at", F.when(F.col("seq") % 5 == 0, "2024-02-01"))
    return monitor.unresolved(found, 10).select("source", "scope_date", "seq")


_STATUS = "case event_type when 'view' then 'running' when 'error' then 'failed' else 'ok' end"


@query(f"select user_id as run, arg_max({_STATUS}, event_id) as status, min(event_id) as started, coalesce(max(event_id) filter (where {_STATUS} <> 'running'), -1) as finished from events group by user_id")
def run_states(spark, sf_dir):
    log = table(spark, sf_dir, "events").selectExpr("user_id as run", "event_id as at", f"{_STATUS} as status", "event_type as summary")
    return monitor.run_states(log).select("run", "status", "started", F.coalesce("finished", F.lit(-1)).alias("finished"))


@query("select user_id as run, min(event_id) as started from events group by user_id order by started desc, run desc limit 1")
def latest_agent_run(spark, sf_dir):
    log = table(spark, sf_dir, "events").selectExpr("user_id as run", "event_id as at", "'running' as status", "event_type as summary")
    return monitor.latest_agent_run(log).select("run", "started")


@query("with " + DUCK_RUNS + " select source, scope_date, case when status <> 'error' then 'ok' when required then 'error' when stored > 0 then 'warning' else 'unavailable' end as outcome, cast(case when status <> 'error' then stored else 0 end as bigint) as event_count, status = 'error' and required as incident from (select *, scope_date < '2024-01-15' as required, seq % 3 as stored from runs)")
def scope_outcomes(spark, sf_dir):
    """What a failure means for each scope: an incident for required days, a warning or nothing for later ones; scopes stand alone."""
    runs = adapter.runs(spark, sf_dir)
    o = monitor.scope_outcome(F.col("status") == "error", F.col("scope_date") < "2024-01-15", F.col("seq") % 3)
    return runs.select("source", "scope_date", o.alias("o")).select("source", "scope_date", F.col("o.status").alias("outcome"), "o.event_count", "o.incident")


@query("with flips as (select c_custkey as reader, count(o_orderkey) % 2 = 1 as flip from customer left join orders on o_custkey = c_custkey group by 1) select reader from flips where (reader % 3 = 0) <> flip")
def subscription_toggle(spark, sf_dir):
    readers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("reader"))
    changes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("reader"), F.col("o_orderkey").alias("ord"))
    return monitor.toggled(readers.where("reader % 3 = 0"), changes)


# messages and views ------------------------------------------------------------------------
_DISPLAYED = "case ord % 4 when 0 then title when 1 then tournament || ' финал' when 2 then sport else 'Финал' end"


@query(duck("select ord, case when ord % 4 = 0 then replace(title, 'КОМАНДА', 'Команда') when ord % 4 = 1 then tournament || ' финал' when ord % 4 = 2 then array_to_string(list_filter([sport, tournament], lambda x: x <> ''), '. ') else array_to_string(list_filter([sport, tournament, 'Финал'], lambda x: x <> ''), '. ') end as shown from bx"))
def display_titles(spark, sf_dir):
    rows = bx(spark, sf_dir).select("ord", F.expr(_DISPLAYED).alias("said"), "sport", "tournament")
    shown = text.display_title(F.col("said"), F.col("sport"), F.col("tournament"))
    return texts.made_once(rows, ["said", "sport", "tournament"], {"shown": shown}).select("ord", "shown")


@query("select identity, channel, field, case field when 'channel_added' then '➕ Новое LIVE-событие' || chr(10) || identity || chr(10) || '🕐 ' || channel || ' · 📺 ' || channel when 'channel_removed' then '➖ Событие исчезло из расписания' || chr(10) || identity || chr(10) || 'Было: ' || channel || ' · ' || channel when 'end' then '🔔 Изменение расписания' || chr(10) || identity || chr(10) || '🏁 ' || channel || ': ' || \"old\" || ' → ' || \"new\" else '🔔 Изменение расписания' || chr(10) || identity || chr(10) || '🕐 ' || channel || ': ' || \"old\" || ' → ' || \"new\" end as body from (" + joined.QUERIES["channel_diff"][1] + ")")
def change_messages(spark, sf_dir):
    d = joined.channel_diff(spark, sf_dir)
    kind = F.when(F.col("field") == "channel_added", "added").when(F.col("field") == "channel_removed", "removed").otherwise("updated")
    line = text.change_line(kind, F.col("field"), F.col("channel"), F.col("old"), F.col("new"))
    return d.select("identity", "channel", "field", text.change_text(kind, F.col("identity"), F.array(line)).alias("body"))


@query(duck("select r.reader, m.source, m.date from (select distinct source, date from bx) m join (select c_custkey as reader, case c_custkey % 3 when 0 then 'guide_a' when 1 then 'guide_b' else 'guide_c' end as source from customer where c_custkey % 5 = 0) r using (source)"))
def message_deliveries(spark, sf_dir):
    readers = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("reader"), F.expr("case c_custkey % 3 when 0 then 'guide_a' when 1 then 'guide_b' else 'guide_c' end").alias("source"))
    return monitor.deliveries(bx(spark, sf_dir).select("source", "date").distinct(), readers).select("reader", "source", "date")


@query(duck(f"select ord, (select count(*) from dd where {D_FAILED} is null) as total from dd where {D_FAILED} is null order by date, time, channel, ord limit 25", *BASE))
def bounded_view(spark, sf_dir):
    return schedule.bounded_view(schedule.visible(bx(spark, sf_dir), NOW), 25).select("ord", "total")


@query(duck("select strftime(start_at, '%Y-%m-%d %H:%M') as start_text, sport, title, transport from (select start_at, sport, title, 0 as transport, ord from bx where ord % 2 = 0 union all select start_at, sport, upper(title), 1, ord from bx where ord % 3 <> 0) qualify row_number() over (partition by start_at, sport, lower(title) order by transport, title) = 1"))
def calendar_merge(spark, sf_dir):
    rows = bx(spark, sf_dir).select("ord", "start_at", "sport", "title")
    return calendars.merged(rows.where("ord % 2 = 0").dropDuplicates(["start_at", "sport", "title"]).drop("ord"), rows.where("ord % 3 <> 0").withColumn("title", F.upper("title")).dropDuplicates(["start_at", "sport", "title"]).drop("ord")).select(F.date_format("start_at", "yyyy-MM-dd HH:mm").alias("start_text"), "sport", "title", "transport")


@query(duck("select ord, strftime(case when date_diff('day', date '2024-01-10', make_date(2024, m, d)) > 180 then make_date(2023, m, d) else make_date(2024, m, d) end, '%Y-%m-%d') as dated from (select ord, 1 + ord % 12 as m, 1 + ord % 28 as d from bx) where abs(date_diff('day', date '2024-01-10', case when date_diff('day', date '2024-01-10', make_date(2024, m, d)) > 180 then make_date(2023, m, d) else make_date(2024, m, d) end)) <= 180"))
def heading_date(spark, sf_dir):
    got = bx(spark, sf_dir).select("ord", clock.near_year((1 + F.col("ord") % 28).cast("int"), (1 + F.col("ord") % 12).cast("int"), F.lit("2024-01-10").cast("date")).alias("d"))
    return got.where("d is not null").select("ord", F.date_format("d", "yyyy-MM-dd").alias("dated"))
