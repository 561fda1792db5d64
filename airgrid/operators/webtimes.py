"""Start times that search results and the pages behind them state about an event.

A result is judged together with the event it was found for.  Where in a text an event is named, and
which clocks stand there, needs positions of matches, which built-in expressions do not give; so pairs
of event and text go through Arrow batches once, which emit windows or clocks as rows.  Which day a
clock belongs to, which of several is best, what sources agree on and how far that is from the slot
are relational again.

Tables: events (event, title, tournament, sport, start_at: local), results (event, place, tier,
rank, url, title, snippet; tier 1 is the second search, heard only where the first found nothing
about the event), pages (url, page_url, page_title, content).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import clock, lexicon, text
from ..sources.shared import settled
from . import verify

# How far a window reaches, how much of a text without names is read, how windows are told apart.
RADIUS = 500
UNNAMED = 6_000
GRAIN = 100
SHORTEST_ANCHOR = 4
# Clocks by the zone that is stated after them, in the order in which they are read; and what tells that a bare clock has a zone.
CLOCKS = (
    ("UTC", re.compile(r"(?<!\d)(\d{1,2}):(\d{2})(?::\d{2})?\s*(am|pm)?\s*(?:UTC|GMT)(?!\w)", re.I)),
    ("MSK", re.compile(r"(?<!\d)(\d{1,2}):(\d{2})()\s*(?:MSK|МСК|Moscow time)", re.I)),
    ("local", re.compile(r"(?<![\d:])(\d{1,2}):(\d{2})(?::\d{2})?\s*(am|pm)?", re.I)),
    ("local", re.compile(r"(?<![\d:])(\d{1,2})()\s*(am|pm)(?!\w)", re.I)),
)
#: The last of them has no colon.
HALVES = len(CLOCKS) - 1
ZONE_STATED, ZONE_REACH = re.compile(r"\s*(?:UTC|GMT|MSK|МСК|Moscow time)", re.I), 15
ZONES = {"UTC": "UTC", "MSK": "Europe/Moscow"}
#: All forms of the letters that cues begin with.
FORMS = {"k": "kK\u212a", "s": "sS\u017f", "b": "bB", "t": "tT", "н": "нН", "с": "сС\u1c83", "в": "вВ\u1c80", "э": "эЭ"}


def _cue(*words: str) -> re.Pattern:
    """Any of the words in any case.  Each begins with a plain letter, so a text is looked through for those letters and only there for words."""
    return re.compile("|".join(f"{form}(?i:{w[1:]})" for w in words for form in FORMS[w[0]]))


# Words beside a clock, the most they are worth, and how far they are heard.
CUES = (
    (_cue(r"kick[\s-]?off", "start(?:s|ing)?", "begins?", "начал[оа]?", "старт", "начн[её]тся"), 180, 120),
    (_cue("scheduled", "schedule", "time", "время", "эфир"), 60, 80),
)
STATED = 100
# Minutes from the slot up to which a time agrees, agrees softly, and is taken at all.
AGREES, SOFT, TAKEN = 10, 20, 30
PAGES_READ = 5


def anchors(title: Column, tournament: Column) -> Column:
    """What an event is named by in texts: the sides of a match, a draw's tournament, or title and tournament; in either language, longest first."""
    english = text.englished
    sides = F.flatten(F.transform(text.participants(title), lambda x: F.array(x, text.transliterated(x), english(x), english(text.transliterated(x)))))
    draw = F.array(tournament, english(tournament), F.lit("draw"), F.lit("жереб"))
    plain = F.array(title, english(title), tournament, english(tournament))
    kind = text.event_kind(title)
    terms = F.when(kind == "MATCH", sides).when(kind == "DRAW", draw).otherwise(plain)
    long = F.filter(F.array_distinct(F.transform(terms, lambda x: F.btrim(F.coalesce(x, F.lit(""))))), lambda x: F.length(x) >= SHORTEST_ANCHOR)
    return F.transform(F.array_sort(F.transform(long, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda p: p["x"])


def windows_in(said: str, terms: list[str]) -> list[tuple[int, int, str]]:
    """left, right, term of the windows around all places of all terms; of windows that hardly differ the first, and the text's start if there are none."""
    low = said.casefold()
    found: dict[tuple[int, int], tuple[int, int, str]] = {}
    for term in terms:
        folded = term.casefold()
        at = low.find(folded)
        while at >= 0:
            left, right = max(0, at - RADIUS), min(len(said), at + len(term) + RADIUS)
            found.setdefault((left // GRAIN, right // GRAIN), (left, right, term))
            at = low.find(folded, at + len(folded))
    if not found and said:
        return [(0, min(len(said), UNNAMED), "")]
    return list(found.values())


def _minutes(h: str, m: str, half: str | None) -> int | None:
    hour, minute = int(h), int(m or 0)
    if half:
        hour = hour % 12 + 12 * (half.lower() == "pm") if 1 <= hour <= 12 else 24
    return hour * 60 + minute if hour < 24 and minute < 60 else None


def _told(pattern: re.Pattern, window: str, halves: bool) -> Iterator[re.Match]:
    """``pattern.finditer(window)``, looked for only where a clock can begin: at the digits before a colon, or (``halves``: hours with am or pm alone) in texts with either."""
    if halves:
        low = window.lower()
        yield from pattern.finditer(window) if "am" in low or "pm" in low else ()
        return
    end, colon = 0, window.find(":")
    while colon >= 0:
        at = colon - 2 if colon >= 2 and window[colon - 2].isdecimal() and window[colon - 1].isdecimal() else colon - 1
        if at >= end and (m := pattern.match(window, at)):
            yield m
            end = m.end()
        colon = window.find(":", colon + 1)


def clocks_in(window: str, zoned: bool) -> Iterator[tuple[int, str, int]]:
    """Minute of the day, zone and worth of each clock; clocks without a zone only on pages that have one (``zoned``).

    A stated zone is worth 100; of the cue words near a clock the one that is worth most counts, less a point for each character between.
    """
    cues = None
    for k, (zone, pattern) in enumerate(CLOCKS):
        if zone == "local" and not zoned:
            continue
        for m in _told(pattern, window, k == HALVES):
            at = _minutes(*m.groups())
            if at is None or zone == "local" and ZONE_STATED.match(window[m.end() : m.end() + ZONE_REACH]):
                continue
            if cues is None:
                cues = [([c.span() for c in cue.finditer(window)], most, reach) for cue, most, reach in CUES]
            worth = 0
            for spans, most, reach in cues:
                near = min((min(abs(m.start() - b), abs(m.end() - a)) for a, b in spans), default=reach + 1)
                if near <= reach:
                    worth = max(worth, most - near)
            yield at, zone, worth + STATED * (zone != "local")


def times_in(said: str, terms: list[str], zoned: bool) -> list[tuple[int, int, str, int]]:
    """Where it was read first, minute of the day, zone and best worth of every time near the terms, each once."""
    best: dict[tuple[int, str], list[int]] = {}
    read = 0
    for left, right, _ in windows_in(said, terms):
        for at, zone, worth in clocks_in(said[left:right], zoned):
            one = best.setdefault((at, zone), [read, worth])
            one[1] = max(one[1], worth)
            read += 1
    return [(first, at, zone, worth) for (at, zone), (first, worth) in best.items()]


def best_of(times: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """The time that a text states best: with a zone first, then by worth, then the first read."""
    return [max(times, key=lambda t: (t[2] != "local", t[3], -t[0]))] if times else []


def _emitted(pairs: DataFrame, keep: list[str], read: list[str], fields: tuple[tuple[str, T.DataType], ...], find) -> DataFrame:
    """``keep`` columns and ``fields``: a row for everything that ``find`` finds in the values of ``read``."""
    schema = T.StructType([*(pairs.schema[k] for k in keep), *(T.StructField(n, t) for n, t in fields)])
    kinds = [to_arrow_type(t) for _, t in fields]

    def work(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for i, values in enumerate(zip(*(batch.column(c).to_pylist() for c in read), strict=True)):
                for x in find(*values):
                    row.append(i)
                    found.append(x)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in keep), *(pa.array([x[k] for x in found], t) for k, t in enumerate(kinds))], names=schema.names)

    return pairs.select(*dict.fromkeys([*keep, *read])).mapInArrow(work, schema)


def context_windows(pairs: DataFrame, keys: list[str], said: str = "said", terms: str = "terms") -> DataFrame:
    """keys, left, right (characters, the end exclusive), term: the windows of each text; an empty text has none."""
    fields = (("left", T.IntegerType()), ("right", T.IntegerType()), ("term", T.StringType()))
    return _emitted(pairs, keys, [said, terms], fields, lambda x, t: windows_in(x or "", t or []))


def zone_of(name: Column) -> Column:
    """The zone of a host's bare clocks, or null."""
    hours = verify.zone_hours(name)
    return F.when(hours == 3, ZONES["MSK"]).when(name.endswith(".kz"), lexicon.ZONE).when(hours.isNotNull(), F.concat(F.lit("+"), F.lpad(hours.cast("string"), 2, "0"), F.lit(":00")))


def extracted_times(pairs: DataFrame, keep: list[str], day: str = "day", url: str = "url", said: str = "said", terms: str = "terms", best: bool = False) -> DataFrame:
    """keep, at (local), original, explicit, score, read: the times told near an event's names, each once with its best score; or the ``best`` of each text.

    ``day``: the event's date, of which and of whose neighbours the clocks are; ``read`` tells what is read first.
    """
    pages = pairs.withColumns({"_day": F.col(day).cast("date"), "_zone": zone_of(verify.host(F.col(url)))})
    fields = (("read", T.IntegerType()), ("_minutes", T.IntegerType()), ("_told", T.StringType()), ("score", T.IntegerType()))

    def find(zone, x, t):
        found = times_in(x or "", t or [], zone is not None)
        return best_of(found) if best else found

    got = _emitted(pages, [*keep, "_day", "_zone"], ["_zone", said, terms], fields, find)
    zone = F.coalesce(*(F.when(F.col("_told") == k, F.lit(v)) for k, v in ZONES.items()), F.col("_zone"))
    original = F.format_string("%02d:%02d %s", F.expr("_minutes div 60"), F.col("_minutes") % 60, F.col("_told"))
    return got.select(*keep, clock.aligned_in(F.col("_day"), F.col("_minutes"), zone).alias("at"), original.alias("original"), (F.col("_told") != "local").alias("explicit"), "score", "read")


def named(events: DataFrame) -> DataFrame:
    """Events with facts (what a text must say to be about one) and terms (what names it); made once for each distinct event."""
    of = ["title", "tournament", "sport"]
    known = events.select(*of).distinct().select(*of, verify.facts(*map(F.col, of)).alias("facts"), anchors(F.col("title"), F.col("tournament")).alias("terms"))
    return events.join(known.withColumnsRenamed({c: f"_{c}" for c in of}), F.expr(" and ".join(f"{c} <=> _{c}" for c in of))).drop(*(f"_{c}" for c in of))


def _sourced(rows: DataFrame) -> DataFrame:
    """``rows`` (url) with the source's organisation and weight."""
    organisation = text.bound(verify.host(F.col("url")), verify.base_domain)
    return rows.withColumn("organisation", organisation).withColumn("weight", verify.source_weight(F.col("organisation")))


def _is_about(said: Column, facts: Column) -> Column:
    """Whether a text is about an event; it is normalised once, however many names are looked for."""
    return F.coalesce(text.bound(text.norm_verify(said), lambda x: verify.told(x, facts)), F.lit(False))


def matching(events: DataFrame, results: DataFrame) -> DataFrame:
    """Results that are about their event, with what they say, the event's names, its day and the source's organisation and weight.

    ``events`` as ``named`` gives them; ``results``: event, url, title, snippet, content where pages were read, and any other columns.
    """
    told = verify.result_text(F.col("title"), F.col("snippet"), None, F.col("content") if "content" in results.columns else None)
    own = events.select("event", "facts", "terms", F.to_date("start_at").alias("day"))
    pairs = results.withColumn("said", told).join(own, "event")
    return _sourced(pairs.where(_is_about(F.col("said"), F.col("facts"))).drop("facts"))


def collected(about: DataFrame, key: str = "event") -> DataFrame:
    """One candidate of each of the ``matching`` results that tell a time: event (or another ``key``), place, organisation, weight, at, original, explicit, score."""
    return extracted_times(about, [key, "place", "organisation", "weight"], best=True).drop("read")


def once(results: DataFrame) -> DataFrame:
    """Results without repeats (equal address and title, without case); of equal ones the first of the first search.  An event's are few, and in one task already where they were joined by event."""
    same = Window.partitionBy("event", F.lower("url"), F.lower("title")).orderBy("tier", "place", "rank", "url", "title", "snippet")
    return results.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")


def heard(results: DataFrame) -> DataFrame:
    """Results (about: whether they are about their event) that count: of the second search only where the first found none about the question's events."""
    answered = results.where("about and tier = 0").select("question").distinct()
    return results.where("tier = 0").unionByName(results.where("tier <> 0").join(answered, "question", "left_anti"))


def to_read(about: DataFrame, n: int = PAGES_READ) -> DataFrame:
    """The pages of a question to read: one of each organisation by rank, the ``n`` best of those by weight and rank."""
    rank = F.coalesce(F.nullif(F.col("rank"), F.lit(0)), F.lit(9999))
    rows = about.where("url <> ''").withColumns({"light": -F.col("weight"), "rank": rank})
    of_each = Window.partitionBy("question", "organisation").orderBy("light", "rank", "place", "url", "title", "snippet")
    best = rows.repartition("question").withColumn("_n", F.row_number().over(of_each)).where("_n = 1")
    order = Window.partitionBy("question").orderBy("light", "rank", "place")
    return best.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n", "light")


def verified(events: DataFrame, results: DataFrame, pages: DataFrame, minutes: int = TAKEN, seconds: int = 600) -> DataFrame:
    """Per event: state, method, at, difference, organisations, weight, confidence, agreement, matching, n_results, n_read.

    Times that pages tell win over those of search results.  They are clustered, the cluster with most weight
    wins, its candidate of most weight and score speaks for it, and only then is it compared with the slot:
    state is verified, or rejected if further than ``minutes`` from it; no_time if results are about the event
    but tell none; none if no result is.

    ``events`` may have a ``question``: those that share one are asked about together, and what is found for
    any of them speaks for all, each by its own slot; else each event is a question of its own.
    """
    of = ["title", "tournament", "sport"]
    slots = events if "question" in events.columns else events.withColumn("question", F.col("event"))
    # what is known by texts alone is stored once for each different text and looked up by number, not carried along
    facts = verify.facts(*map(F.col, of)).alias("facts")
    known = settled(slots.select(*of).distinct().select(*of, F.monotonically_increasing_id().alias("text"), facts, anchors(F.col("title"), F.col("tournament")).alias("terms")), "texts")
    names = known.select("text", *(F.col(c).alias(f"_{c}") for c in of))
    own = slots.join(names, F.expr(" and ".join(f"{c} <=> _{c}" for c in of))).select("event", "question", F.to_date("start_at").alias("day"), "text")
    said = verify.result_text(F.col("title"), F.col("snippet"))
    found = once(results.select("event", "place", "tier", "rank", "url", "title", "snippet").join(own, "event"))
    judged = found.join(known.select("text", "facts"), "text").withColumn("about", _is_about(said, F.col("facts"))).drop("facts")
    all_results = settled(heard(settled(_sourced(judged), "judged")), "heard")
    about = all_results.where("about")
    read = settled(verify.with_pages(to_read(about).drop("organisation", "weight"), pages).select("question", "place", "url", "day", "text", verify.result_text(F.col("title"), F.col("snippet"), None, F.col("content")).alias("said")), "read")
    pages_about = _sourced(read.join(known.select("text", "facts", "terms"), "text").where(_is_about(F.col("said"), F.col("facts"))).drop("facts"))
    told = settled(collected(pages_about, "question"), "told")
    # snippets are read only where no page tells a time
    unread = about.join(told.select("question").distinct(), "question", "left_anti").withColumn("said", said).join(known.select("text", "terms"), "text")
    every = told.withColumn("method", F.lit("page_extract")).unionByName(collected(unread, "question").withColumn("method", F.lit("search_snippet")))
    each = settled(every.select("question", F.col("place").alias("ord"), F.unix_timestamp("at").alias("at"), "score", "organisation", F.col("weight").cast("long").alias("weight"), "method"), "candidates")
    grouped = settled(verify.clusters(each, ["question"], seconds), "clusters")
    won = settled(verify.vote(grouped, ["question"]), "won")
    mine = grouped.join(won, ["question", "cluster"], "left_semi")
    spoken = mine.groupBy("question").agg(F.max_by("at", F.struct("weight", "score", -F.col("at"), -F.col("ord"))).alias("at"), F.first("method").alias("method"))
    counts = all_results.groupBy("question").agg(F.count("*").alias("n_results"), F.count_if("about").alias("matching"))
    n_read = read.groupBy("question").agg(F.count("*").alias("n_read"))
    of_each = counts.join(n_read, "question", "left").join(spoken, "question", "left").join(won.select("question", "organisations", "weight"), "question", "left")
    out = slots.select("event", "question", "start_at").join(of_each, "question", "left")
    gap = F.expr("(at - unix_timestamp(start_at)) div 60")
    found = F.col("at").isNotNull() & (F.abs(gap) <= minutes)
    state = F.when(found, "verified").when(F.col("at").isNotNull(), "rejected").when(F.col("matching") > 0, "no_time").otherwise("none")
    sources, weight = (F.when(found, F.col(c)).otherwise(0) for c in ("organisations", "weight"))
    sure = F.when((sources >= 2) & (weight >= 120), "high").when((sources >= 2) | (weight >= 70), "medium").otherwise("low")
    agreement = F.when(F.abs(gap) <= AGREES, "agrees").when(F.abs(gap) <= SOFT, "soft").otherwise("differs")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "event", state.alias("state"), F.coalesce("method", F.lit("none")).alias("method"), F.timestamp_seconds("at").alias("at"), gap.alias("difference"), sources.alias("organisations"), weight.alias("weight"),
        F.when(found, sure).alias("confidence"), F.when(found, agreement).alias("agreement"), zero("matching"), zero("n_results"), zero("n_read"),
    )


#: What a reader is told of a verdict.
VERDICTS = {
    "unavailable": "🔴 Внешняя проверка сейчас недоступна",
    "rejected": "⚠️ Внешнее время отброшено как ненадёжное",
    "none": "⚪ Надёжного внешнего подтверждения времени нет",
    "unknown": "🟡 Событие найдено, время требует ручной проверки",
    "agrees": "✅ Время подтверждено",
    "soft": "🟡 Мягкое расхождение — нужна дополнительная проверка",
    "differs": "⚠️ Существенное расхождение времени",
}


def verdict_text(unavailable: Column, state: Column, difference: Column) -> Column:
    """What a reader is told: of a search that failed, a time that was rejected, none found, or how far the found one is off."""
    key = (
        F.when(unavailable, "unavailable").when(state == "rejected", "rejected").when(state != "verified", "none").when(difference.isNull(), "unknown")
        .when(F.abs(difference) <= AGREES, "agrees").when(F.abs(difference) <= SOFT, "soft").otherwise("differs")
    )
    return text.first_equal(key, VERDICTS)
