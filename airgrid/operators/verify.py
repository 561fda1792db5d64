"""Search results about an event: sources, weights, start times, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon, text
from . import ordered
from .texts import made_once


def host(url: Column) -> Column:
    """Folded, without user, port and www; an empty string where there is none."""
    authority = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(authority, r"^www\.", "")


def base_domain(name: Column) -> Column:
    """The last two labels, or three under a two-level suffix; unknown for none."""
    parts = F.split(name, r"\.")
    two = name.rlike(r"(^|\.)[^.]+\.(" + "|".join(s.replace(".", r"\.") for s in lexicon.TWO_LEVEL_SUFFIXES) + ")$")
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - (n - 1), F.lit(1)), F.lit(n)), ".")
    return F.when(name == "", "unknown").when(two, last(3)).otherwise(last(2))


def source_weight(domain: Column) -> Column:
    return (
        F.when(domain.isin(*lexicon.OFFICIAL_DOMAINS), 100)
        .when(domain.isin(*lexicon.MEDIA_DOMAINS), 70)
        .when(domain.isin(*lexicon.DATABASE_DOMAINS), 60)
        .when(domain.rlike("|".join(lexicon.BETTING_WORDS)), 20)
        .otherwise(40)
    )


def zone_hours(name: Column) -> Column:
    """Hours east of a source's clock: by domain, then by country, else null."""
    table = F.create_map(*(F.lit(v) for p in lexicon.DOMAIN_HOURS.items() for v in p))
    ends = F.create_map(*(F.lit(v) for p in lexicon.SUFFIX_HOURS.items() for v in p))
    return F.coalesce(F.try_element_at(table, name), F.try_element_at(table, base_domain(name)), F.try_element_at(ends, F.element_at(F.split(name, r"\."), -1)))


def zone_name(domain: Column) -> Column:
    """The zone of a page's bare clocks, by name: by base domain, then by country, else null."""
    table = F.create_map(*(F.lit(v) for p in lexicon.DOMAIN_ZONES.items() for v in p))
    ends = F.create_map(*(F.lit(v) for p in lexicon.SUFFIX_ZONES.items() for v in p))
    return F.coalesce(F.try_element_at(table, domain), F.try_element_at(ends, F.element_at(F.split(domain, r"\."), -1)))


def occurrence_weight(domain: Column) -> Column:
    """As ``source_weight``, but a wider list of official domains weighs 100 at least."""
    return F.when(domain.isin(*lexicon.OFFICIAL_EVENT_DOMAINS), 100).otherwise(source_weight(domain))


def search_dedup(results: DataFrame) -> DataFrame:
    """The first of results with equal url and title, without case."""
    from .schedule import first_by

    return first_by(results, [F.lower("url"), F.lower("title")], ["ord"])


def extraction_choice(results: DataFrame, n: int = 5) -> DataFrame:
    """Pages to read: the best of each domain by weight and rank, the n best of those."""
    r = results.withColumn("domain", base_domain(host(F.col("url"))))
    r = r.withColumn("weight", source_weight(F.col("domain")))
    best = r.groupBy("domain").agg(F.min(F.struct((-F.col("weight")).alias("w"), "ord", "url")).alias("b"))
    return best.select("domain", (-F.col("b.w")).alias("weight"), F.col("b.ord").alias("ord"), F.col("b.url").alias("url")).orderBy(F.col("weight").desc(), "ord").limit(n)


def clusters(candidates: DataFrame, keys: list[str], seconds: int = 600) -> DataFrame:
    """Candidates with cluster: start of the group whose first member is at most ``seconds`` before.

    Anchored on the first member, so a chain of near times does not grow without end.  The different
    instants of a question are walked in order, one at a time; ``candidates`` has keys, ord, at (epoch seconds).
    """
    kinds = ", ".join(f"`{k}` {candidates.schema[k].dataType.simpleString()}" for k in keys)

    def step(state: list, at: int):
        if state[1] is None or at - state[1] > seconds:
            state[1] = at
        yield *state[0], at, state[1]

    folded = ordered.walked(candidates.select(*keys, "at").distinct(), keys, ["at"], ["at"], f"{kinds}, at long, cluster long", lambda *key: [key, None], step)
    return candidates.join(folded, [*keys, "at"])


def vote(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """The winning cluster of each question: most weight (one voice an organisation), organisations, members, then the earliest."""
    voices = clustered.groupBy(*keys, "cluster", "organisation").agg(F.max("weight").alias("weight"), F.count("*").alias("n"))
    tally = voices.groupBy(*keys, "cluster").agg(F.sum("weight").alias("weight"), F.count("*").alias("organisations"), F.sum("n").alias("members"))
    best = tally.groupBy(*keys).agg(F.max(F.struct("weight", "organisations", "members", (-F.col("cluster")).alias("early"))).alias("b"))
    return best.select(*keys, (-F.col("b.early")).alias("cluster"), "b.weight", "b.organisations", "b.members")


def best_time(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The time stated most plainly: explicit first, then score, then first listed."""
    best = candidates.groupBy(*keys).agg(F.max(F.struct("explicit", "score", (-F.col("ord")).alias("first"), "at")).alias("b"))
    return best.select(*keys, "b.at", "b.explicit", "b.score")


def consensus(candidates: DataFrame, keys: list[str], minutes: int = 30) -> DataFrame:
    """confirmed: by one voice of weight 100, or by two or more with 100 together, among times within ``minutes`` of the slot."""
    near = candidates.where(F.abs("difference") <= minutes).groupBy(*keys, "organisation").agg(F.max("weight").alias("weight"))
    tally = near.groupBy(*keys).agg(F.max("weight").alias("top"), F.sum("weight").alias("weight"), F.count("*").alias("organisations"))
    sure = (F.col("top") >= 100) | ((F.col("organisations") >= 2) & (F.col("weight") >= 100))
    level = F.when((F.col("organisations") >= 2) & (F.col("weight") >= 120), "high").when((F.col("organisations") >= 2) | (F.col("weight") >= 70), "medium").otherwise("low")
    return tally.select(*keys, "organisations", "weight", sure.alias("confirmed"), level.alias("confidence"))


def result_text(title: Column, snippet: Column, description: Column | None = None, content: Column | None = None) -> Column:
    """All that a search result says."""
    said = [F.coalesce(c, F.lit("")) for c in (title, snippet, description, content) if c is not None]
    return F.concat_ws(" ", *said)


def tournament_told(said: Column, tournament: Column) -> Column:
    """Whether a normalised text names a tournament, in either language, or has all of its telling words."""
    names = F.filter(F.array(text.norm_verify(tournament), text.norm_verify(text.englished(tournament))), lambda x: x != "")
    tokens = text.significant_tokens(tournament)
    whole = F.exists(names, lambda x: said.contains(x)) | ((F.size(tokens) > 0) & F.forall(tokens, lambda w: said.contains(w)))
    return (F.btrim(F.coalesce(tournament, F.lit(""))) != "") & whole


def telling_words(title: Column, tournament: Column, sport: Column) -> Column:
    """Words of an event that say which one it is; all of four letters or more where none does."""
    expected = F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in (title, tournament, sport)))
    plain = F.filter(F.array_distinct(F.split(text.norm_verify(text.englished(expected)), " ")), lambda w: F.length(w) >= 4)
    tokens = text.significant_tokens(expected)
    return F.when(F.size(tokens) > 0, tokens).otherwise(plain)


def facts(title: Column, tournament: Column, sport: Column) -> Column:
    """What an event is known by: kind, the aliases of each side, telling words, tournament.  Made once for each distinct text."""
    sides = F.transform(text.participants(title), text.aliases)
    return F.struct(text.event_kind(title).alias("kind"), sides.alias("sides"), telling_words(title, tournament, sport).alias("words"), F.coalesce(tournament, F.lit("")).alias("tournament"))


def told(said: Column, of: Column) -> Column:
    """Whether a normalised text is about an event of these ``facts``: each side by an alias, a draw with its tournament, or two telling words."""
    both = F.forall(of["sides"], lambda names: F.exists(names, lambda x: said.contains(x)))
    draw = (said.contains("draw") | said.contains("жереб")) & tournament_told(said, of["tournament"])
    hits = F.size(F.filter(of["words"], lambda w: said.contains(w)))
    some = (F.size(of["words"]) > 0) & (hits >= F.least(F.lit(2), F.size(of["words"])))
    return F.when(of["kind"] == "MATCH", both).when(of["kind"] == "DRAW", draw).otherwise(some)


def matches(result: Column, title: Column, tournament: Column, sport: Column | None = None) -> Column:
    """Whether a result's text is about an event."""
    return told(text.norm_verify(result), facts(title, tournament, F.lit("") if sport is None else sport))


def relaxed(result: Column, title: Column, tournament: Column, sport: Column) -> Column:
    """``matches``, or the tournament's name, or two long words that are not common ones."""
    said = text.norm_verify(text.englished(result))
    name = text.norm_verify(text.englished(tournament))
    expected = text.norm_verify(text.englished(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in (title, tournament, sport)))))
    words = F.filter(F.array_except(F.array_distinct(F.split(expected, " ")), F.array(*map(F.lit, lexicon.STOP_WORDS))), lambda w: (F.length(w) >= 5) & ~w.rlike("^[0-9]+$"))
    hits = F.size(F.filter(words, lambda w: said.contains(w)))
    return matches(result, title, tournament, sport) | ((F.length(name) >= 5) & said.contains(name)) | ((F.size(words) > 0) & (hits >= F.least(F.lit(2), F.size(words))))


def query_strings(rows: DataFrame, day: str = "start_at") -> DataFrame:
    """``rows`` (title, tournament, sport and a day) with two searches for the event, first and second: all that names it in English with its date, and the same with words for its start.

    Names are put into English once for each different event.  A date is English as it is: it begins with a month's
    name, and no known name has such letters, so none reaches into it.
    """
    said = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("title", "tournament", "sport")))
    named = made_once(rows.withColumn("_said", said), ["_said"], {"_english": text.englished(F.col("_said"))})
    first = F.btrim(F.concat_ws(" ", "_english", F.date_format(day, "MMMM dd yyyy")))
    return named.withColumn("first", first).withColumn("second", F.concat("first", F.lit(" start time schedule"))).drop("_said", "_english")


def with_pages(results: DataFrame, pages: DataFrame) -> DataFrame:
    """Results (url, title, ...) that a page with content was read for; the page's own address and title win.

    ``pages``: url, page_url, page_title, content.
    """
    read = pages.where(F.btrim(F.coalesce("content", F.lit(""))) != "")
    own = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), F.col(b), F.lit(""))
    return results.join(read, "url").withColumns({"url": own(F.col("page_url"), "url"), "title": own(F.col("page_title"), "title")}).drop("page_url", "page_title")


def best_per_key(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Of candidates (keys, ord, score) with equal keys the best, of equally good ones the first."""
    rest = [c for c in candidates.columns if c not in keys]
    best = candidates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("score", -F.col("ord"))).alias("b"))
    return best.select(*keys, "b.*")


def unique_sources(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One candidate of each organisation, the one of most weight, numbered by weight."""
    best = candidates.groupBy(*keys, "organisation").agg(F.max_by(F.struct("weight", "ord", "at"), F.struct("weight", -F.col("ord"))).alias("b")).select(*keys, "organisation", "b.*")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("weight").desc(), "ord"))  # a question's organisations are few
    return best.withColumn("place", place)


def verdict(candidates: DataFrame, slots: DataFrame, keys: list[str], seconds: int = 600, minutes: int = 30) -> DataFrame:
    """Per slot (keys, start in epoch seconds): state, difference and organisations of the time that most weight stands for.

    Times are clustered, the cluster with most weight wins, and its candidate of most weight and score speaks for
    it; further than ``minutes`` from the slot it is rejected, without candidates the slot is unknown.
    """
    grouped = clusters(candidates, keys, seconds)
    won = vote(grouped, keys)
    mine = grouped.join(won.select(*keys, "cluster", "organisations"), [*keys, "cluster"])
    spoken = mine.groupBy(*keys).agg(F.max_by("at", F.struct("weight", "score", -F.col("ord"))).alias("at"), F.first("organisations").alias("organisations"))
    out = slots.join(spoken, keys, "left").withColumn("difference", ((F.col("at") - F.col("start")) / 60).cast("long"))
    state = F.when(F.col("at").isNull(), "unknown").when(F.abs("difference") <= minutes, "verified").otherwise("rejected")
    return out.select(*keys, state.alias("state"), "difference", F.coalesce("organisations", F.lit(0)).alias("organisations"))


def is_official(domains: Column) -> Column:
    """Whether any of a verdict's sources holds the events itself."""
    return F.exists(domains, lambda d: d.isin(*lexicon.OFFICIAL_EVENT_DOMAINS))


def calendar_first(calendar: DataFrame, searched: DataFrame, key: str = "ord", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per slot: state and where it comes from.  What the calendar says holds; else a search's verdict, if an official source stands behind it; else unknown.

    ``calendar``: key, state (confirmed, mismatch, unknown); ``searched``: key, state, domains; ``keep``: further columns of either that stay.
    """
    mine, theirs = ([c for c in keep if c in df.columns] for df in (calendar, searched))
    j = calendar.select(key, "state", *mine).join(searched.select(key, F.col("state").alias("found"), "domains", *(c for c in theirs if c not in mine)), key, "left")
    known = F.col("state") != "unknown"
    fallback = F.coalesce(is_official(F.col("domains")) & (F.col("found") != "unknown"), F.lit(False))
    return j.select(key, F.when(known, F.col("state")).when(fallback, F.col("found")).otherwise("unknown").alias("state"), F.when(known, "calendar").when(fallback, "official").otherwise("none").alias("by"), *keep)
