"""Scans of programme guides: rows from markup, text and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock, evidence, text, titles
from ..functions import lexicon as L
from ..operators import windows
from ..operators.schedule import first_by
from ..operators.texts import made_once
from . import html
from .shared import settled

TIME = r"(?<!\d)([01]\d|2[0-3]):[0-5]\d(?!\d)"
# What counts as a live mark in attributes and in markup between two times.
LIVE_TOKEN = r"(^|[/_.-])live([/_.-]|$)"
LIVE_CLASS = r"(^|[-_ ])live([-_ ]|$)"
LIVE_MARKUP = r"(?i)>\s*live\s*<|\b(?:class|alt|title|src|data-[\w-]+)\s*=\s*[\"'][^\"']*(?<![\p{L}\d])live(?![\p{L}\d])[^\"']*[\"']"


def page_date(title: Column) -> Column:
    """The first DD.MM.YYYY of a title; null without one."""
    return F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(title, r"(\d{2}\.\d{2}\.\d{4})", 1), F.lit("")), F.lit("dd.MM.yyyy")))


def clean_title(raw: Column, time: Column) -> Column:
    """Without the word LIVE, the first of its time, and dashes at the ends."""
    t = F.regexp_replace(raw, r"(?i)\bLIVE\b", "")
    at = F.instr(t, time)
    cut = F.when((at > 0) & (time != ""), F.concat(F.substr(t, F.lit(1), at - 1), F.substr(t, at + F.length(time)))).otherwise(t)
    return F.btrim(F.regexp_replace(cut, r"\s+", " "), F.lit(" -–—"))


def anchors(pages: DataFrame, key: str = "page_id", markup: str = "html") -> DataFrame:
    """Programme rows of a guide of links: key, ord, time, title, is_live, has_badge, day_offset, offset, next_offset.

    The first row of each day, time and text stays; the clock going back begins the next day;
    ends are the next programme's start, over all rows.
    """
    every = html.elements(pages, key, markup)
    badge = F.coalesce(F.lower("text") == "live", F.lit(False))
    for attr in ("title", "alt", "src"):
        badge = badge | F.coalesce(F.lower(F.try_element_at("attrs", F.lit(attr))).rlike(LIVE_TOKEN), F.lit(False))
    badge = badge | F.coalesce(F.lower(F.try_element_at("attrs", F.lit("class"))).rlike(LIVE_CLASS), F.lit(False))
    seen = every.withColumn("badge", badge).where("badge or tag = 'a'").select(key, "ord", "last", "tag", "badge", F.when(F.col("tag") == "a", F.col("text")).alias("text"))
    seen = html.following(seen, key, badge_at=(F.col("badge"), F.col("ord")))
    links = seen.where("tag = 'a'").withColumn("time", F.regexp_extract("text", TIME, 0)).where("time <> ''")
    has_badge = F.coalesce(F.col("badge_at") <= F.col("last"), F.lit(False)).alias("has_badge")
    rows = links.select(key, "ord", "time", clean_title(F.col("text"), F.col("time")).alias("title"), F.upper("text").contains("LIVE").alias("is_live"), has_badge, clock.minute_of_day(F.col("time")).alias("minute"))
    rolled = windows.rollover(rows, [key], "ord", "minute")
    once = first_by(rolled.select("ord", key, "time", "title", "is_live", "has_badge", "day_offset", (F.col("day_offset") * 1440 + F.col("minute")).alias("offset")), [F.col(key), F.col("day_offset"), F.col("time"), F.col("title")], ["ord"])
    return windows.next_end(once, [key], ["offset", "ord"], "offset").withColumnRenamed("next_start", "next_offset")


def dated(rows: DataFrame, pages: DataFrame, key: str, markup: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the date that their page's title states, later days by their offset; and key, error of pages that state none."""
    titles_ = html.elements(pages, key, markup, ("title",)).groupBy(key).agg(F.min_by("text", "ord").alias("_title"))
    stated = pages.select(key).join(titles_, key, "left").select(key, page_date(F.col("_title")).alias("_date"))
    good = rows.join(stated.where("_date is not null"), key).withColumn("date", F.date_add("_date", F.col("day_offset").cast("int"))).drop("_date")
    return good, stated.where("_date is null").select(key, F.lit("no date in the title").alias("error"))


def live_times(said: Column) -> Column:
    """All times with LIVE before them, each once."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.regexp_replace(said, r"\s+", " "), F.lit(r"(?i)\bLIVE (([01]\d|2[0-3]):[0-5]\d)"), F.lit(1))))


def gap_live_times(markup: Column) -> Column:
    """Times with a live mark between the time before and them."""
    times = F.regexp_extract_all(markup, F.lit(TIME), F.lit(0))
    gaps = F.split(markup, TIME, -1)
    marked = F.filter(F.arrays_zip(times.alias("t"), F.slice(gaps, 1, F.size(times)).alias("g")), lambda x: x["g"].rlike(LIVE_MARKUP))
    return F.array_sort(F.array_distinct(F.transform(marked, lambda x: x["t"])))


def header_dates(values: Column, reference: Column) -> Column:
    """Dates of day labels (struct day, month) in order: the first in the year nearest to the reference, each next the first after the one before."""

    def options(v: Column) -> Column:
        dates = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", F.year(reference) + k, v["month"], v["day"]), F.lit("yyyy-MM-dd"))))
        return F.array_compact(dates)

    def step(acc: Column, v: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        later = F.filter(options(v), lambda d: d > last)
        nearest = F.array_min(F.transform(options(v), lambda d: F.struct(F.abs(F.date_diff(d, reference)).alias("far"), d.alias("d"))))["d"]
        chosen = F.when(F.size(acc) == 0, nearest).when(F.size(later) > 0, F.array_min(later)).otherwise(F.array_max(options(v)))
        return F.when(F.size(options(v)) > 0, F.array_append(acc, chosen)).otherwise(acc)

    return F.aggregate(values, F.array().cast("array<date>"), step)


def string_rows(pages: DataFrame, key: str, markup: str, reference: str) -> DataFrame:
    """Programme rows of a guide of plain strings: key, date, ord, time, title.

    Day labels before the first time give the dates; each time takes the next string that is no
    label or arrow, unless a time comes first; blocks of rows, cut at the anthem or in the
    morning, take the dates in turn; rows after midnight are of the next day.
    """
    is_time = F.col("text").rlike(r"^([01]?\d|2[0-3]):[0-5]\d$")
    label = F.regexp_extract("text", r"^(?:[\p{L}.]+,?\s*)?(\d{1,2}\.\d{1,2})(?:\s*[\p{L}.,]+)?$", 1)
    # a page is read once, and its strings are asked for clocks and labels once
    n = settled(html.text_nodes(pages, key, markup).withColumns({"is_time": is_time, "label": label}), "strings")
    first = n.where("is_time").groupBy(key).agg(F.min("ord").alias("first_time"))
    heads = n.join(first, key, "left").where("label <> '' and (first_time is null or ord < first_time)")
    value = F.struct("ord", F.split("label", r"\.")[0].cast("int").alias("day"), F.split("label", r"\.")[1].cast("int").alias("month"))
    dates = heads.groupBy(key).agg(header_dates(F.array_sort(F.collect_list(value)), F.lit(reference).cast("date")).alias("dates"), F.max("ord").alias("head_end"))
    w = Window.partitionBy(key).orderBy("ord")
    body = n.join(dates, key).where("ord > head_end and (is_time or (label = '' and text not in ('◀', '▶')))")
    pairs = body.withColumns({"title": F.lead("text").over(w), "next_time": F.lead("is_time").over(w)}).where("is_time and title is not null and not next_time")
    pairs = pairs.select(key, "ord", F.lpad("text", 5, "0").alias("time"), "title", "dates").withColumn("minute", clock.minute_of_day(F.col("time")))
    blocks = windows.day_blocks(pairs, [key], "ord", "minute", F.lower("title").contains("әнұраны"))
    rolled = windows.rollover(blocks, [key, "block"], "ord", "minute")
    return rolled.select(key, F.date_add(F.get("dates", F.col("block").cast("int")), F.col("day_offset").cast("int")).alias("date"), "ord", "time", "title").where("date is not null")


def direct_rows(rows: DataFrame) -> DataFrame:
    """Of a guide of strings' rows, those said to be direct and of a known sport, with sport, tournament and name."""
    made = {"_direct": evidence.direct_by_marker(F.col("title")), "_t": titles.string_title(F.col("title"))}
    named = made_once(settled(rows, "rows"), ["title"], made).where("_direct and _t.sport <> ''")
    return named.withColumns({"sport": F.col("_t.sport"), "tournament": F.col("_t.tournament"), "name": F.col("_t.title")}).drop("_direct", "_t")


def without_dates(pages: DataFrame, key: str, markup: str, reference: str) -> DataFrame:
    """key, error of pages that have no day label before their first clock: an error, not an empty day."""
    return pages.select(key).join(string_rows(pages, key, markup, reference).select(key).distinct(), key, "left_anti").withColumn("error", F.lit("no day labels"))


def on_air_times(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """key, time of list items with a blinking link that says live: what is on now, which is no claim of a direct broadcast."""
    every = html.elements(pages, key, markup, ("div", "a", "li", "span"), "li")
    tag, clock_ = F.col("tag"), F.col("text").rlike(r"^([01]?\d|2[0-3]):[0-5]\d$")
    token = F.array_contains(F.split(F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit("")), r"\s+"), "blink")
    said = F.when(tag == "a", F.lower(F.concat_ws(" ", F.try_element_at("attrs", F.lit("title")), "text")))
    told = every.select(key, "ord", "last", "tag", "within", token.alias("blink"), said.alias("said"), F.when((tag == "span") & clock_, F.col("text")).alias("time"))
    told = told.where("tag = 'a' or tag = 'li' or (tag = 'div' and blink) or time is not null")
    at = lambda c: F.struct("ord", F.col(c).alias("x"))
    told = html.following(told, key, link=(tag == "a", at("said")), clock=(F.col("time").isNotNull(), at("time")))
    live = (tag == "div") & F.col("blink") & (F.col("link.ord") <= F.col("last")) & F.col("link.x").contains("live")
    first = F.when((tag == "li") & (F.col("clock.ord") <= F.col("last")), F.col("clock.x"))
    # an item's first clock is told by the item's row, that it blinks by rows within it
    of = told.select(key, F.when(tag == "li", F.col("ord")).otherwise(F.col("within")).alias("item"), live.alias("live"), first.alias("time")).where("item >= 0 and (live or time is not null)")
    items = of.groupBy(key, "item").agg(F.max("live").alias("live"), F.max("time").alias("time"))
    return items.where("live and time is not null").select(key, "time").distinct()


EPG = "pages array<struct<events array<struct<title string, eventDescriptionMedium string, scheduledFor struct<begin string, end string>>>>>"


def epg_rows(payloads: DataFrame, channel: str = "channel", date: str = "date", body: str = "body") -> DataFrame:
    """Rows of a provider's JSON: channel, date, time, end_at, raw_title, evidence state; of the date asked for, the first of each time and title.

    Clocks lose their zone mark here and are read as local; ``clock.local`` turns them later.
    """
    ev = payloads.select(channel, date, F.from_json(body, EPG).alias("j")).select(channel, date, F.posexplode("j.pages").alias("p", "page")).select(channel, date, "p", F.posexplode("page.events").alias("i", "e"))
    wall = lambda c: F.try_to_timestamp(F.regexp_replace(c, "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    r = ev.select(F.struct("p", "i").alias("ord"), channel, date, wall(F.col("e.scheduledFor.begin")).alias("start_at"), wall(F.col("e.scheduledFor.end")).alias("end_at"), text.collapsed(F.col("e.title")).alias("raw_title"), text.collapsed(F.concat_ws(" ", "e.title", "e.eventDescriptionMedium")).alias("said"))
    r = r.where((F.date_format("start_at", "yyyy-MM-dd") == F.col(date)) & (F.col("raw_title") != ""))
    r = r.withColumn("time", F.date_format("start_at", "HH:mm")).withColumn("claim", evidence.classified(F.col("said"))).withColumn("live_state", F.col("claim.state"))
    return first_by(r, [F.col(channel), F.col(date), F.col("time"), F.col("raw_title")], ["ord"]).drop("ord", "said")


def tournament_and_title(rest: Column) -> Column:
    """tournament, title of a provider's line: parted by a colon that a match follows, or by the last comma, semicolon or dot before a match.

    A match is two sides with a spaced dash or versus between them; without one all is title.
    """
    versus = r"(?i)\s(?:[-–—]|vs\.?|v\.)\s"
    edge = F.lit(" .,-–—")

    def placed(line: Column) -> Column:
        colon = F.instr(line, ":")
        before = F.split(line, versus, 2)[0]
        # the place of the last mark before the match: what follows it has none
        marks = F.length(F.regexp_extract(before, r"^(.*[,;.])", 1))
        at = F.when((colon > 0) & F.substr(line, colon + 1).rlike(versus), colon - 1).when(line.rlike(versus) & (marks > 1) & (F.btrim(F.substr(before, marks + 1)) != ""), marks)
        return F.struct(line.alias("line"), colon.alias("colon"), at.alias("at"))

    def parted(v: Column) -> Column:
        line, at = v["line"], v["at"]
        skip = F.when((v["colon"] > 0) & (at == v["colon"] - 1), 1).otherwise(0)
        both = F.struct(F.btrim(F.substr(line, F.lit(1), at), edge).alias("tournament"), F.btrim(F.substr(line, at + skip + 1), edge).alias("title"))
        return F.when(at.isNotNull(), both).otherwise(F.struct(F.lit("").alias("tournament"), line.alias("title")))

    return text.bound(text.bound(F.btrim(rest, F.lit(" .-–—")), placed), parted)


# Sports that a provider's titles begin with, in order, and what may stand behind one.
PROVIDER_SPORTS = (
    ("Пляжный волейбол", "Пляжный волейбол"), ("Спортивная гимнастика", "Спортивная гимнастика"), ("Тяжёлая атлетика", "Тяжёлая атлетика"), ("Тяжелая атлетика", "Тяжёлая атлетика"), ("Вольная борьба", "Борьба"), ("Автоспорт", "Автоспорт"),
    ("Мотоспорт", "Мотоспорт"), ("Волейбол", "Волейбол"), ("Баскетбол", "Баскетбол"), ("Футбол", "Футбол"), ("Хоккей", "Хоккей"), ("Теннис", "Теннис"), ("Снукер", "Снукер"), ("Бильярд", "Бильярд"), ("Дзюдо", "Дзюдо"), ("Бокс", "Бокс"), ("ММА", "MMA"), ("MMA", "MMA"),
)
BEHIND_SPORT = r"(?:\s*[.:,-]\s*|\s+)"


def provider_title(raw: Column, hint: Column | None = None) -> Column:
    """sport, tournament, title of a provider's line: a sport's name at the start or the channel's ``hint``, then what ``tournament_and_title`` makes of the rest."""
    edge = F.lit(" .-–—")
    clean = F.btrim(F.regexp_replace(text.collapsed(raw), r"(?iu)\s*[.·-]?\s*(?:" + "|".join(L.LIVE_MARKERS) + r")\s*$", ""), edge)
    known = rf"(?iu)^({'|'.join(text._quoted(n) for n, _ in PROVIDER_SPORTS)}){BEHIND_SPORT}"

    def named(v: Column) -> Column:
        clean, sport = v["clean"], v["sport"]
        rest = F.when(sport.isNotNull(), F.btrim(F.regexp_replace(clean, known, ""), edge)).otherwise(clean)
        say = lambda p: F.struct(F.coalesce(sport, F.lit("") if hint is None else hint).alias("sport"), p["tournament"].alias("tournament"), F.coalesce(F.nullif(p["title"], F.lit("")), clean).alias("title"))
        return text.bound(tournament_and_title(rest), say)

    def told(clean: Column) -> Column:
        sport = text.first_equal(F.lower(F.regexp_extract(clean, known, 1)), {n.lower(): s for n, s in PROVIDER_SPORTS})
        return F.struct(clean.alias("clean"), sport.alias("sport"))

    return text.bound(text.bound(clean, told), named)


def projected(rows: DataFrame) -> DataFrame:
    """``epg_rows`` as events: with sport, tournament and title, and the provider's own claim (state, method, value, confidence)."""
    method = F.regexp_replace(F.col("claim.method"), "^official_", "provider_")
    named = made_once(rows, ["raw_title"], {"_t": provider_title(F.col("raw_title"))})
    return named.select("channel", "date", "time", "end_at", "raw_title", "_t.sport", "_t.tournament", "_t.title", (F.col("claim.state") == "live").alias("is_live"), "live_state", method.alias("method"), F.col("claim.value").alias("value"), F.col("claim.confidence").alias("confidence"))


def string_guide(pages: DataFrame, key: str, markup: str, reference: str, source: str = "guide") -> DataFrame:
    """A guide of strings whole: its direct rows with the evidence for each, and what that comes to (on_air, claimed, strength).

    A row's own words claim that it is direct; a blinking link beside its clock says that it is on now, which is no such claim.
    """
    rows = direct_rows(string_rows(pages, key, markup, reference))
    on_air = on_air_times(pages, key, markup).withColumn("_on", F.lit(True))
    told = rows.join(on_air, [key, "time"], "left")
    one = evidence.with_evidence(F.lit(None).cast(evidence.EVIDENCE), F.lit("official_live_text"), F.lit(source), F.col("title"), F.lit("high"))
    both = evidence.with_evidence(one, F.lit("official_on_air_marker"), F.lit(source), F.col("time"), F.lit("medium"))
    out = told.withColumn("evidence", F.when(F.col("_on"), both).otherwise(one)).drop("_on")
    return out.withColumn("claims", evidence.claims(F.col("evidence")))


# Fixed value: what a page says is on now.
BANNER = r"(?iu)(?:СЕЙЧАС\s+В\s+ЭФИРЕ|в\s+эфире)\s+LIVE\s+(\d{2}:\d{2})\s+(.+?)\s+Смотреть\s+онлайн"


def banner(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """key, time, title of what a page's banner says is on now; no row without one."""
    nodes = html.text_nodes(pages, key, markup)
    said = nodes.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("said"))
    return said.select(key, F.regexp_extract("said", BANNER, 1).alias("time"), text.collapsed(F.regexp_extract("said", BANNER, 2)).alias("title")).where("time <> ''")


def with_banner(rows: DataFrame, on_now: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, time, title, is_live, has_badge, day_offset, offset) with the banner's programme, unless they have it.

    Its day is the first of three that lies within the rows' span, or else the one nearest to either end of it.
    """
    rows = settled(rows, "rows")
    span = rows.groupBy(key).agg(F.min("offset").alias("low"), F.max("offset").alias("high"))
    m = clock.minute_of_day(F.col("time"))

    def option(k: int) -> Column:
        at = m + 1440 * k
        inside = at.between(F.col("low"), F.col("high"))
        far = F.when(inside, 0).otherwise(F.least(F.abs(at - F.col("low")), F.abs(at - F.col("high"))))
        return F.struct((~inside).alias("outside"), far.alias("far"), at.alias("at"))

    best = F.array_min(F.array(*(option(k) for k in range(3))))["at"]
    placed = on_now.join(span, key, "left").select(key, "time", "title", F.lit(True).alias("is_live"), F.lit(False).alias("has_badge"), F.coalesce(best, m).alias("offset"))
    placed = placed.withColumn("day_offset", F.floor(F.col("offset") / 1440))
    new = placed.join(rows, [key, "day_offset", "time", "title"], "left_anti")
    cols = [key, "time", "title", "is_live", "has_badge", "day_offset", "offset"]
    return rows.select(*cols).unionByName(new.select(*cols))


def confirmed(rows: DataFrame, pages: DataFrame, key: str, markup: str) -> DataFrame:
    """``rows`` with method and confidence of the page's own word that a time is direct: a badge in a row of that time, or a mark in text or markup.

    What is so marked is parsed anew; without a sport it is on the air but not direct.
    """
    badges = rows.where("has_badge").select(key, "time").distinct().withColumn("_badge", F.lit(True))
    nodes = html.text_nodes(pages, key, markup).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("said"))
    told = pages.select(key, gap_live_times(F.col(markup)).alias("gaps")).join(nodes, key, "left").select(key, F.explode(F.array_union("gaps", F.coalesce(live_times(F.col("said")), F.array().cast("array<string>")))).alias("time")).withColumn("_told", F.lit(True))
    # by page and time, one row each: a page's times beside each of its rows would make the rows as many times larger
    r = rows.join(badges, [key, "time"], "left").join(told, [key, "time"], "left")
    method = F.when(F.col("_badge"), "official_live_badge").when(F.col("_told"), "guide_page_live_text")
    r = r.withColumn("method", method).drop("_badge", "_told")
    named = titles.guide_title(F.col("title"))
    r = r.withColumn("named", F.when(F.col("method").isNotNull(), named))
    direct = F.col("method").isNotNull() & (F.col("named.sport") != "")
    return r.withColumns({"confidence": F.when(F.col("method") == "official_live_badge", "high").when(F.col("method").isNotNull(), "medium"), "direct": F.coalesce(direct, F.lit(False))})
