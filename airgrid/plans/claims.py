"""Queries of what says that a broadcast is direct, and of what a calendar was read from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence, lexicon
from ..operators import schedule
from ..sources import calendars, html
from .adapter import bx, duck, table
from .basic import D_EDITORIAL, q, ts

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


# hints in markup: of navigation bars, advertisements and whole bodies
_FIRST_ONLY = lambda xs: f"list_filter({xs}, lambda x, i: x <> '' and list_position({xs}, x) = i)"
_UNESCAPED = lambda x: f"replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_HINTED = "list_transform(regexp_extract_all({0}, ' (?:href|class)=\"([^\"]*)\"', 1), lambda x: " + _UNESCAPED("x") + ")"
_HINTS = (
    "bare as (select page_id, regexp_replace(regexp_replace(html, '<script>.*?</script>', '', 'gs'), '<!--.*?-->', '', 'gs') as h from pages)",
    "parts as (select page_id, 'nav' as tag, regexp_extract(h, '<nav>.*?</nav>', 0, 's') as part from bare where contains(h, '<nav>') union all select page_id, 'body', regexp_extract(h, '<body>.*', 0, 's') from bare where contains(h, '<body>') union all select page_id, 'div', unnest(regexp_extract_all(h, '<div[^>]*>')) from bare)",
    f"hinted as (select page_id, tag, {_HINTED.format('part')} as xs from parts)",
    f"hints as (select page_id, tag, {_FIRST_ONLY('xs')} as hints from hinted)",
)


@query("with " + ", ".join(_HINTS) + " select page_id, tag, array_to_string(hints, '|') as hints from hints")
def asset_hints(spark, sf_dir):
    got = html.asset_hints(table(spark, sf_dir, "pages"), "page_id", "html", ("nav", "div", "body"))
    return got.select("page_id", "tag", F.array_join("hints", "|").alias("hints"))


_PATTERNS = (" ", "/the", "AD")


@query("with " + ", ".join(_HINTS) + " select page_id, case when h1 <> '' or h2 <> '' then 'live' else 'unknown' end as state, case when h1 <> '' then h1 when h2 <> '' then h2 else '' end as value from (select page_id, coalesce(list_filter(hints, lambda x: contains(lower(x), '/the'))[1], '') as h1, coalesce(list_filter(hints, lambda x: contains(lower(x), 'ad'))[1], '') as h2 from hints where tag = 'nav')")
def asset_classify(spark, sf_dir):
    """Navigation bars that say nothing, by patterns in their hints."""
    got = html.asset_hints(table(spark, sf_dir, "pages"), "page_id", "html", ("nav",))
    return got.select("page_id", evidence.classified_with_assets(F.lit("schedule"), F.col("hints"), _PATTERNS).alias("e")).select("page_id", "e.state", "e.value")


# direct by method: rows with and without a flag, of a provider and of guides, by all kinds of methods
_METHODS = [*lexicon.EXPLICIT_METHODS, "official_on_air_marker", ""]
_STATED = "case when ord % 4 = 0 then is_live_broadcast end as flag, case when ord % 3 = 0 then 'epg' else source end as origin, ord % 5 <> 1 as legacy, case when ord % 7 < 5 then 'live' else 'unknown' end as state"
_D_DIRECT = "not editorial and coalesce(flag, case when origin = 'epg' then legacy and state = 'live' and method in ({0}) else legacy end)".format(", ".join(map(q, lexicon.EXPLICIT_METHODS)))
_D_STATED = f"stated as (select *, {_D_DIRECT} as direct from (select ord, {D_EDITORIAL} as editorial, {_STATED}, [{', '.join(map(q, _METHODS))}][1 + ord % {len(_METHODS)}] as method from bx))"


def _stated(spark, sf_dir):
    method = F.get(F.array(*map(F.lit, _METHODS)), (F.col("ord") % len(_METHODS)).cast("int")).alias("method")
    rows = bx(spark, sf_dir).selectExpr("*", *(f"{x}" for x in _STATED.split(", "))).select("*", schedule.editorial().alias("editorial"), method)
    direct = evidence.is_direct_by_method(*(F.col(c) for c in ("editorial", "flag", "origin", "legacy", "state", "method")))
    return rows.withColumn("direct", direct)


@query(duck("select ord, direct from stated", _D_STATED))
def direct_by_method(spark, sf_dir):
    return _stated(spark, sf_dir).select("ord", "direct")


@query(duck("select ord, case when method in ({0}) then state = 'live' and not editorial else direct and origin <> 'epg' end as official from stated".format(", ".join(map(q, lexicon.EXPLICIT_METHODS))), _D_STATED))
def official_live(spark, sf_dir):
    rows = _stated(spark, sf_dir)
    return rows.select("ord", evidence.is_official(*(F.col(c) for c in ("editorial", "direct", "origin", "state", "method"))).alias("official"))


# a calendar's page for each day: markup on some, a root that is thin on some, sections
_ROOT = "case when dayofmonth(start_at) % 3 = 0 then ord % 30 = 1 else ord % 3 <> 0 end"
_D_PARTS = (
    "direct as (select date as page, start_at, sport, title, 0 as transport from bx where ord % 2 = 0 and day(start_at) % 4 <> 1)",
    f"root as (select date as page, start_at, sport, title, 1 as transport from bx where {_ROOT.replace('dayofmonth', 'day')})",
    "sections as (select date as page, start_at, sport, upper(title) as title, 2 as transport from bx where ord % 5 <> 2 and day(start_at) % 5 <> 2 and date not in (select page from root group by page having count(*) >= 25))",
    "every as (select * from direct union all select * from root union all select * from sections)",
    "one as (select * from every qualify row_number() over (partition by page, start_at, sport, lower(title) order by transport, title) = 1)",
)


def _transports(spark, sf_dir):
    rows = bx(spark, sf_dir).withColumn("page", F.col("date"))
    direct, root = rows.where("ord % 2 = 0 and dayofmonth(start_at) % 4 <> 1"), rows.where(_ROOT)
    sections = rows.where("ord % 5 <> 2 and dayofmonth(start_at) % 5 <> 2").withColumn("title", F.upper("title"))
    return calendars.transports(direct, root, sections, "page")


@query(duck("select page, strftime(start_at, '%Y-%m-%d %H:%M') as start_text, sport, title, transport from one", *_D_PARTS))
def calendar_transports(spark, sf_dir):
    rows, _ = _transports(spark, sf_dir)
    return rows.select("page", ts("start_at").alias("start_text"), "sport", "title", "transport")


@query(duck("select page, case when bool_or(t = 0) and bool_or(t > 0) then 'direct+reader' when bool_or(t = 2) then 'reader_sections' when bool_or(t = 1) then 'reader' else 'direct' end as transport, any_value(events) as events, any_value(sports) as sports, any_value(dates) as dates from (select page, transport as t from every) join (select page, count(*) as events, count(distinct sport) as sports, array_to_string(list_sort(list_distinct(list(strftime(start_at, '%Y-%m-%d')))), ',') as dates from one group by page) using (page) group by page", *_D_PARTS))
def calendar_fetched(spark, sf_dir):
    """What each page was read from, with the dates and the number of sports that it tells."""
    _, told = _transports(spark, sf_dir)
    return told.withColumn("dates", F.array_join("dates", ","))
