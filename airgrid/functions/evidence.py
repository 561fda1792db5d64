"""What a text or a provider says about a broadcast being direct; three facts that stay apart:
on the air now, claimed to be direct, confirmed by the event itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import bound, collapsed, contains_any

EVIDENCE = "array<struct<method:string,source:string,value:string,confidence:string>>"


def event_text(*parts: Column) -> Column:
    return F.upper(collapsed(F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts))))


def is_editorial(*parts: Column) -> Column:
    return contains_any(event_text(*parts), L.EDITORIAL_MARKERS)


def _first_marker(x: Column, markers) -> Column:
    return F.coalesce(*(F.when(x.contains(m), F.lit(m)) for m in markers))


def classified(text: Column) -> Column:
    """state, method, value, confidence of a provider's text: replay words win, then phrases, then a bare LIVE as a word of its own."""
    say = lambda state, method, value, confidence: F.struct(F.lit(state).alias("state"), F.lit(method).alias("method"), value.alias("value"), F.lit(confidence).alias("confidence"))

    def marked(t: Column) -> Column:
        word = F.concat(F.lit(" "), F.translate(t, "/-", "  "), F.lit(" ")).contains(" LIVE ")
        return F.struct(_first_marker(t, L.REPLAY_MARKERS).alias("replay"), _first_marker(t, L.LIVE_MARKERS[:-1]).alias("phrase"), word.alias("word"))

    def told(m: Column) -> Column:
        return (
            F.when(m["replay"].isNotNull(), say("not_live", "official_replay_text", m["replay"], "high"))
            .when(m["phrase"].isNotNull(), say("live", "official_live_text", m["phrase"], "high"))
            .when(m["word"], say("live", "official_live_text", F.lit("LIVE"), "high"))
            .otherwise(say("unknown", "no_explicit_live_marker", F.lit(""), "unknown"))
        )

    return bound(bound(F.upper(collapsed(text)), marked), told)


def classified_with_assets(text: Column, hints: Column, patterns: tuple[str, ...]) -> Column:
    """As ``classified``; where a text says neither, the first pattern, in order, that a hint contains (without case) tells a direct broadcast, and the first such hint is its value."""
    said = classified(text)
    wanted = [p.strip().lower() for p in patterns if p.strip()]
    hit = lambda p: F.get(F.filter(hints, lambda h: F.lower(h).contains(p)), F.lit(0))
    hint = F.coalesce(*map(hit, wanted)) if wanted else F.lit(None).cast("string")
    asset = F.struct(F.lit("live").alias("state"), F.lit("official_live_asset").alias("method"), hint.alias("value"), F.lit("medium").alias("confidence"))
    return F.when((said["state"] == "unknown") & hint.isNotNull(), asset).otherwise(said)


def is_direct(editorial: Column, flag: Column, legacy: Column) -> Column:
    """Not editorial, and flagged; a missing flag (null) falls back on the legacy one."""
    return ~editorial & F.coalesce(flag, legacy, F.lit(False))


def is_direct_by_method(editorial: Column, flag: Column, source: Column, legacy: Column, state: Column, method: Column) -> Column:
    """As ``is_direct``; without a flag, a provider's listing must also state so by a method that counts."""
    stated = (state == "live") & method.isin(*L.EXPLICIT_METHODS)
    own = F.when(F.lower(F.coalesce(source, F.lit(""))) == L.PROVIDER, F.coalesce(legacy & stated, F.lit(False))).otherwise(legacy)
    return is_direct(editorial, flag, own)


def is_official(editorial: Column, direct: Column, source: Column, state: Column, method: Column) -> Column:
    """Stated live by a method that counts and not editorial; by any other method direct, but not in a provider's listing."""
    counts = F.coalesce(method.isin(*L.EXPLICIT_METHODS), F.lit(False))
    return F.when(counts, F.coalesce(state == "live", F.lit(False)) & ~editorial).otherwise(direct & (F.coalesce(source, F.lit("")) != L.PROVIDER))


def is_candidate(editorial: Column, sport_event: Column, direct: Column, sport: Column, tournament: Column, text: Column) -> Column:
    named = (F.btrim(F.coalesce(sport, F.lit(""))) != "") | (F.btrim(F.coalesce(tournament, F.lit(""))) != "")
    return ~editorial & F.coalesce(sport_event, direct | named | contains_any(text, L.SPORT_MARKERS))


def is_user_event(title: Column, sport: Column, tournament: Column) -> Column:
    """Studio programmes without sport and tournament are not for users."""
    bare = (F.btrim(F.coalesce(sport, F.lit(""))) == "") & (F.btrim(F.coalesce(tournament, F.lit(""))) == "")
    return ~(contains_any(F.lower(F.coalesce(title, F.lit(""))), L.STUDIO_MARKERS) & bare)


def with_evidence(evidence: Column, method: Column, source: Column, value: Column, confidence: Column) -> Column:
    """``evidence`` with one record more, unless it has it already."""
    one = F.array(F.struct(method.alias("method"), source.alias("source"), value.alias("value"), confidence.alias("confidence")))
    return F.array_union(F.coalesce(evidence, F.array().cast(EVIDENCE)), one.cast(EVIDENCE))


def has_method(evidence: Column, methods) -> Column:
    return F.exists(evidence, lambda e: e["method"].isin(*methods))


def claims(evidence: Column) -> Column:
    """on_air, claimed, third_claimed, strength of all of an event's evidence; an official claim is high, another's medium."""
    official, third = has_method(evidence, L.OFFICIAL_METHODS), has_method(evidence, L.THIRD_PARTY_METHODS)
    return F.struct(has_method(evidence, L.ON_AIR_METHODS).alias("on_air"), official.alias("claimed"), third.alias("third_claimed"), F.when(official, "high").when(third, "medium").otherwise("").alias("strength"))


def direct_by_marker(title: Column) -> Column:
    """A phrase of a direct broadcast and no word of a repeat, anywhere in a title of the guide of strings."""
    t = F.upper(F.coalesce(title, F.lit("")))
    return contains_any(t, L.LIVE_MARKERS[:-1]) & ~contains_any(t, L.REPEATS_B)
