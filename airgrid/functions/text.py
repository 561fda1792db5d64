"""Text for matching and display, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L


def collapsed(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def bound(x: Column, then) -> Column:
    """``then(x)`` with ``x`` worked out once; written out, an expression is worked out again wherever it is used."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def contains_any(x: Column, words) -> Column:
    """Whether any of the words stands in ``x``; one alternation, not a chain of tests."""
    return x.rlike("|".join(_quoted(w) for w in words))


def _quoted(word: str) -> str:
    return "".join("\\" + c if c in r".\+*?[^]$(){}=!<>|:-#/" else c for c in word)


def first_of(x: Column, pairs) -> Column:
    """The value of the first word, in order, that ``x`` contains."""
    return F.coalesce(*(F.when(x.contains(w), F.lit(v)) for w, v in pairs))


def norm_match(x: Column) -> Column:
    """Text for matching: folded, neighbouring letters as one, parentheses and punctuation but for hyphens gone."""
    t = F.translate(F.lower(F.coalesce(x, F.lit(""))), L.MATCH_FROM, L.MATCH_TO)
    t = F.regexp_replace(t, r"\([^)]*\)", " ")
    t = F.translate(t, "–—", "--")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_\s-]+", " ")
    t = F.btrim(F.regexp_replace(t, r"\s+", " "), F.lit(" -"))
    for word, other in L.MATCH_ALIASES.items():
        t = F.regexp_replace(t, rf"(^|[^\p{{L}}\p{{N}}_]){word}($|[^\p{{L}}\p{{N}}_])", f"$1{other}$2")
    return t


def norm_verify(x: Column) -> Column:
    """Text for verification: folded, all punctuation as spaces."""
    t = F.replace(F.lower(F.coalesce(x, F.lit(""))), F.lit("ё"), F.lit("е"))
    # white space is neither letter nor digit, so one look finds it and punctuation
    return F.btrim(F.regexp_replace(t, r"[^\p{L}\p{N}_]+", " "))


def englished(x: Column) -> Column:
    """Known names in English, longest first, also inside words."""
    longest_first = sorted(L.ALIASES.items(), key=lambda p: (-len(p[0]), p[0]))
    plain = F.coalesce(x, F.lit(""))
    out = reduce(lambda t, p: F.regexp_replace(t, f"(?iu){_quoted(p[0])}", p[1]), longest_first, plain)
    # most texts have none of the names; one look tells
    return collapsed(F.when(plain.rlike("(?iu)" + "|".join(_quoted(p[0]) for p in longest_first)), out).otherwise(plain))


def title_of(title: Column, raw_event_title: Column, raw_title: Column) -> Column:
    """The first that is not empty."""
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(raw_event_title, F.lit("")), F.nullif(raw_title, F.lit("")), F.lit(""))


def exact_key(date: Column, time: Column, channel: Column, title: Column) -> Column:
    """One broadcast, whatever guide lists it."""
    return F.concat_ws("|", date, time, norm_match(channel), norm_match(title))


def identity(sport: Column, tournament: Column, title: Column) -> Column:
    """One event, whatever its time and channel."""
    return F.substring(F.sha1(F.concat_ws("|", norm_match(sport), norm_match(tournament), norm_match(title)).cast("binary")), 1, 16)


def storage_id(source: Column, scope: Column, date: Column, time: Column, channel: Column, title: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", source, scope, date, time, channel, title).cast("binary")), 1, 24)


VERSUS = r"\s+(?:-|–|—|vs\.?|v\.)\s+"


def stage_stripped(title: Column) -> Column:
    """Without the stage of a cup that a title begins with, such as 1/4 finals."""
    stage = r"^\s*(?:1[/\\][24]|¼|½)\s*финала?\s*[-:.–—]?\s*"
    return F.btrim(F.regexp_replace(F.coalesce(title, F.lit("")), f"(?iu){stage}", ""))


def transliterated(x: Column) -> Column:
    """Kazakh letters as their Russian neighbours, in either case."""
    return F.translate(F.coalesce(x, F.lit("")), L.KAZAKH_LETTERS, L.RUSSIAN_LETTERS)


def aliases(name: Column) -> Column:
    """A side's name as texts may have it: as it is, transliterated, in English, and both; for comparison, each once."""
    said = [name, transliterated(name), englished(name), englished(transliterated(name))]
    return F.filter(F.array_distinct(F.array(*map(norm_verify, said))), lambda x: x != "")


def participants(title: Column) -> Column:
    """The two sides of a match, or an empty array."""
    parts = F.split(stage_stripped(title), f"(?i){VERSUS}", 2)
    sides = F.filter(F.transform(parts, lambda p: F.btrim(F.regexp_replace(p, r"\s*\([^)]*\)", ""))), lambda p: p != "")
    return F.when((F.size(parts) == 2) & (F.size(sides) == 2), sides).otherwise(F.array().cast("array<string>"))


def event_kind(title: Column) -> Column:
    draw = norm_verify(title).contains("жереб") | norm_verify(englished(title)).contains("draw")
    return F.when(F.size(participants(title)) == 2, "MATCH").when(draw, "DRAW").otherwise("GENERIC")


def significant_tokens(x: Column) -> Column:
    words = F.array_distinct(F.split(norm_verify(englished(x)), " "))
    return F.filter(F.array_except(words, F.array(*map(F.lit, L.GENERIC_WORDS))), lambda w: F.length(w) >= 4)


def sport_hint(x: Column) -> Column:
    """The sport that a text's words tell, or an empty string."""
    return F.coalesce(first_of(F.lower(x), L.SPORT_HINTS), F.lit(""))


def sport_prefix(title: Column, sports: dict[str, str]) -> Column:
    """sport, rest: a sport's name at the start, before a dot or space; the longest name wins."""
    names = sorted(sports, key=lambda s: (-len(s), s))
    low = {k.lower(): v for k, v in sports.items()}
    found = F.lower(F.regexp_extract(title, rf"(?iu)^({'|'.join(map(_quoted, names))})[.\s]", 1))
    sport = F.coalesce(first_equal(found, low), F.lit(""))
    rest = F.btrim(F.regexp_replace(title, rf"(?iu)^({'|'.join(map(_quoted, names))})[.\s]+", ""), F.lit(" ."))
    return F.struct(sport.alias("sport"), F.when(sport == "", title).otherwise(rest).alias("rest"))


def first_equal(x: Column, values: dict[str, str]) -> Column:
    flat = [F.lit(v) for p in values.items() for v in p]
    return F.try_element_at(F.create_map(*flat), x)


def strip_live(title: Column) -> Column:
    """Without a live marker at the end, with or without a place after it."""
    return F.btrim(F.regexp_replace(title, r"(?iu)[\s.,-]*(прямая трансляция|прямой эфир|тікелей эфир|live)(\s+из\s+.*)?[\s.!]*$", ""), F.lit(" .,-"))


#: Runs of signs that a name may stand in, and what is between them; the same for words of letters.
_NAMES, _WORDS = r"([\p{L}\p{N}_-]+|[^\p{L}\p{N}_-]+)", r"([A-Za-zА-Яа-яЁё]+(?:-[A-Za-zА-Яа-яЁё]+)*|[^A-Za-zА-Яа-яЁё]+)"


def _by_piece(x: Column, pattern: str, shown) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), shown), "")


def display(title: Column) -> Column:
    """A title for readers: known phrases and Kazakh letters in Russian, clubs by their usual names, shouting let down but for known short names, spaced dashes.

    Names are looked up whole: a name stands between signs that are no letters, digits or hyphens, so each such
    run of a text is looked up once, however many names there are.
    """
    t = collapsed(F.translate(title, "\u00a0", " "))
    phrases = reduce(lambda x, p: F.regexp_replace(x, f"(?iu){_quoted(p[0])}", p[1]), L.DISPLAY_PHRASES, t)
    t = F.when(t.rlike("(?iu)" + "|".join(_quoted(p[0]) for p in L.DISPLAY_PHRASES)), phrases).otherwise(t)
    names = F.create_map(*(F.lit(v) for p in L.DISPLAY_NAMES.items() for v in p))
    t = _by_piece(transliterated(t), _NAMES, lambda w: F.coalesce(F.try_element_at(names, F.lower(w)), w))

    def let_down(w: Column) -> Column:
        shouted = w.rlike(r"^[A-Za-zА-Яа-яЁё]") & (w == F.upper(w)) & (F.length(F.translate(w, "-", "")) >= 2)
        return F.when(F.upper(w).isin(*L.KEPT_UPPER), F.upper(w)).when(shouted, F.concat(F.substring(w, 1, 1), F.lower(F.substr(w, F.lit(2))))).otherwise(w)

    t = F.regexp_replace(_by_piece(t, _WORDS, let_down), r"\s+[–—-]\s+", " – ")
    return collapsed(F.regexp_replace(t, r"(?<=[\p{L}\p{N}_])[–—](?=[\p{L}\p{N}_])", " – "))


def display_title(title: Column, sport: Column, tournament: Column) -> Column:
    """A title alone if it has two sides or begins with its tournament; else sport, tournament and title, each once."""

    def shown(v: Column) -> Column:
        s, c, t = v["parts"][0], v["parts"][1], v["parts"][2]
        alone = t.rlike(" [–—-] ") | ((c != "") & F.lower(t).startswith(F.lower(c)))
        first = F.filter(v["parts"], lambda x, i: (x != "") & ~F.exists(F.slice(v["parts"], F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))
        return F.when(alone, t).otherwise(bound(first, lambda f: F.when(F.size(f) > 0, F.array_join(f, ". ")).otherwise("Без названия")))

    return bound(F.struct(F.array(display(sport), display(tournament), display(title)).alias("parts")), shown)


#: What a change is called.
CHANGES = {"added": "➕ Новое LIVE-событие", "removed": "➖ Событие исчезло из расписания", "updated": "🔔 Изменение расписания"}


def change_text(change: Column, title: Column, lines: Column) -> Column:
    """A message of a change: its kind, the title, and a line for each broadcast or field."""
    head = F.coalesce(*(F.when(change == k, F.lit(v)) for k, v in CHANGES.items()), F.lit(CHANGES["updated"]))
    return F.array_join(F.concat(F.array(head, F.coalesce(F.nullif(title, F.lit("")), F.lit("Без названия"))), lines), "\n")


def change_line(change: Column, field: Column, channel: Column, old: Column, new: Column) -> Column:
    """One broadcast that came or went, or one field that changed."""
    moved = F.concat(channel, F.lit(": "), old, F.lit(" → "), new)
    return (
        F.when(change == "added", F.concat(F.lit("🕐 "), new, F.lit(" · 📺 "), channel))
        .when(change == "removed", F.concat(F.lit("Было: "), old, F.lit(" · "), channel))
        .when(field == "channels", F.concat(F.lit("📺 Канал: "), F.coalesce(F.nullif(old, F.lit("")), F.lit("нет")), F.lit(" → "), F.coalesce(F.nullif(new, F.lit("")), F.lit("нет"))))
        .when(field == "end", F.concat(F.lit("🏁 "), moved))
        .otherwise(F.concat(F.lit("🕐 "), moved))
    )
