"""Titles of guides, split into sport, tournament and event, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _quoted, bound, first_equal, strip_live

#: Sports as the guide of links names them.
SPORTS_A = {"Футбол": "Футбол", "Волейбол": "Волейбол", "Баскетбол": "Баскетбол", "Хоккей": "Хоккей", "Теннис": "Теннис", "Бокс": "Бокс", "Биатлон": "Биатлон", "Дзюдо": "Дзюдо", "Judo": "Дзюдо", "Шаңғы спорты": "Лыжный спорт", "Жеңіл атлетика": "Лёгкая атлетика"}

#: Words of the guide of links in Russian; each sees what those before it made.
RUSSIAN_A = (
    ("УЕФА Чемпиондар Лигасы", "Лига чемпионов УЕФА"), ("УЕФА Еуропа Лигасы", "Лига Европы УЕФА"), ("УЕФА Конференциялар Лигасы", "Лига конференций УЕФА"), ("Азия чемпионаты", "Чемпионат Азии"), ("Азия кубогы-2029", "Кубок Азии-2029"),
    ("іріктеу турнирі", "Квалификационный турнир"), ("Іріктеу турнирі", "Квалификационный турнир"), ("Плей-офф кезеңі", "Плей-офф"),
    ("жалпы кезеңнің жеребе тарту рәсімі", "Жеребьёвка общего этапа"), ("жалпы кезеңнің жеребе тартуы", "Жеребьёвка общего этапа"), ("жеребе тарту рәсімі", "Жеребьёвка"), ("жеребе тартуы", "Жеребьёвка"),
    ("(Әйелдер)", ". Женщины"), ("(әйелдер)", ". Женщины"), ("Студиялық бағдарлама", "Студийная программа"), ("Матч қарсаңында", "Перед матчем"),
    ("Оңтүстік Корея", "Южная Корея"), ("Қазақстан", "Казахстан"), ("Казахстан чемпионаты", "Чемпионат Казахстана"), ("Қазақстан чемпионаты", "Чемпионат Казахстана"), ("Іріктеу", "Отборочный этап"), ("іріктеу", "Отборочный этап"),
    ("1/2 финал", "1/2 финала"), ("1/4 финал", "1/4 финала"), ("Мальдив аралдары", "Мальдивы"), ("Қырғызстан", "Кыргызстан"), ("Тайланд", "Таиланд"), ("Қайрат", "Кайрат"),
)

EDGES = " .-–—"


def _replaced(x: Column, pairs) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, x)


def russian(x: Column) -> Column:
    """Known words in Russian, in the list's order; single spaces; no marks at the ends."""
    t = _replaced(F.coalesce(x, F.lit("")), ((r"1\4", "1/4"), (r"1\2", "1/2"), *RUSSIAN_A))
    t = _replaced(F.regexp_replace(t, r"\s+", " "), ((" .", "."), ("..", ".")))
    return F.btrim(t, F.lit(EDGES))


def _names(sports: dict[str, str]) -> str:
    return "|".join(map(_quoted, sorted(sports, key=lambda s: (-len(s), s))))


def _known(found: Column, sports: dict[str, str]) -> Column:
    return F.coalesce(first_equal(F.lower(found), {k.lower(): v for k, v in sports.items()}), F.lit(""))


def sport_first(title: Column, sports: dict[str, str] = SPORTS_A) -> Column:
    """sport, rest: a sport at the start, before a dot or space."""
    t = F.btrim(title)
    p = rf"(?iu)^({_names(sports)})(?:\s*\.\s*|\s+)"
    found = F.regexp_extract(t, p, 1)
    return F.struct(_known(found, sports).alias("sport"), F.when(found == "", t).otherwise(F.btrim(F.regexp_replace(t, p, ""), F.lit(EDGES))).alias("rest"))


def sport_last(title: Column, sports: dict[str, str] = SPORTS_A) -> Column:
    """sport, rest: a sport as the last words."""
    t = F.btrim(title)
    p = rf"(?iu)^(.*?)\s+({_names(sports)})$"
    found = F.regexp_extract(t, p, 2)
    return F.struct(_known(found, sports).alias("sport"), F.when(found == "", t).otherwise(F.btrim(F.regexp_extract(t, p, 1), F.lit(EDGES))).alias("rest"))


def by_segments(rest: Column) -> Column:
    """tournament, title: the segment between dots that has a spaced dash, with all after it, is the title; without one both are all."""
    parts = F.filter(F.transform(F.split(rest, r"\."), lambda s: F.btrim(s)), lambda s: s != "")
    hits = F.filter(F.transform(parts, lambda s, i: F.when(s.rlike(r"\s+[–—-]\s+"), i)), lambda i: i.isNotNull())
    at = F.array_max(hits)
    joined = lambda a, n: F.array_join(F.slice(parts, a, n), ". ")
    split = F.struct(F.when(at > 0, joined(F.lit(1), at)).otherwise("").alias("tournament"), joined(at + 1, F.size(parts) - at).alias("title"))
    return F.when(at.isNotNull(), split).otherwise(F.struct(rest.alias("tournament"), rest.alias("title")))


#: What a draw of each cup is told by, and its name; beginnings and marks that part a tournament from an event.
DRAWS_A = ((r"чемпиондар\s+лигас", "Лига чемпионов УЕФА"), (r"еуропа\s+лигас", "Лига Европы УЕФА"), (r"конферен.*лигас|лигас.*конферен", "Лига конференций УЕФА"))
NATIONAL_A, STUDIO_A, YOUTH_A, SLAM_A = "чемпионат казахстана", "студиялық бағдарлама", "QJ League", "Grand Slam"
MARKS_A = ("Плей-офф кезеңі", "іріктеу турнирі", "Іріктеу турнирі", "Финал", "(Әйелдер)", "(әйелдер)")


def guide_title(raw: Column) -> Column:
    """sport, tournament, title of a title of the guide of links; the first rule that holds.

    Draws of the three cups; the national championship, cut at its first dot; judo's grand slam; studio
    programmes, which have no sport; the youth league; a tournament that ends with a mark; else all is title.
    """
    first, last = sport_first(raw), sport_last(raw)
    own = F.when(first["sport"] != "", first).otherwise(last)
    sport, rest = own["sport"], own["rest"]
    low = F.lower(rest)
    say = lambda sport, tournament, title: F.struct(sport.alias("sport"), tournament.alias("tournament"), title.alias("title"))
    cup = F.coalesce(*(F.when(low.rlike(f"(?u){p}"), F.lit(name)) for p, name in DRAWS_A))
    drawn = F.when(low.contains("жалпы кезең"), "Жеребьёвка общего этапа").otherwise("Жеребьёвка")
    parts = F.filter(F.transform(F.split(russian(rest), r"\."), lambda x: F.btrim(x)), lambda x: x != "")
    later = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), ". ")
    slam = low.contains(SLAM_A.lower()) & ((sport == "Дзюдо") | low.contains("дзюдо") | low.contains("judo"))
    bare = russian(F.btrim(F.regexp_replace(rest, r"(?iuU)\b(?:дзюдо|judo)\b", ""), F.lit(EDGES)))
    end = F.coalesce(*(F.when(F.instr(rest, m) > 0, F.instr(rest, m) + len(m) - 1) for m in MARKS_A))
    marked = say(sport, russian(F.btrim(F.substr(rest, F.lit(1), end), F.lit(" ."))), russian(F.btrim(F.substr(rest, end + 1), F.lit(EDGES))))
    none = F.lit("")
    return (
        F.when(cup.isNotNull() & low.contains("жеребе"), say(F.when(sport == "", "Футбол").otherwise(sport), cup, drawn))
        .when(F.lower(russian(rest)).startswith(NATIONAL_A), say(sport, F.get(parts, F.lit(0)), F.when(later == "", F.get(parts, F.lit(0))).otherwise(later)))
        .when(slam, say(F.lit("Дзюдо"), F.lit(SLAM_A), F.when(bare == "", SLAM_A).otherwise(bare)))
        .when(low.startswith(STUDIO_A), say(none, none, russian(rest)))
        .when(low.startswith(YOUTH_A.lower()), say(sport, F.lit(YOUTH_A), russian(F.btrim(F.substr(rest, F.lit(len(YOUTH_A) + 1)), F.lit(EDGES)))))
        .when(end.isNotNull(), marked)
        .otherwise(say(sport, none, russian(rest)))
    )


#: Sports, words and phrases of the guide of strings.
SPORTS_B = {
    "ФУТБОЛ": "Футбол", "ВОЛЕЙБОЛ": "Волейбол", "БАСКЕТБОЛ": "Баскетбол", "БАСКЕТБОЛ 3Х3": "Баскетбол", "БАСКЕТБОЛ 3X3": "Баскетбол", "ХОККЕЙ": "Хоккей", "ТЕННИС": "Теннис", "БОКС": "Бокс", "КӘСІПҚОЙ БОКС": "Бокс", "ММА": "MMA", "ДЗЮДО": "Дзюдо", "JUDO": "Дзюдо", "КАРАТЕ": "Карате", "ТАЕКВОНДО": "Таеквондо", "БОРЬБА": "Борьба", "КҮРЕС": "Борьба", "ПАДЕЛ": "Падел", "НАСТОЛЬНЫЙ ТЕННИС": "Настольный теннис", "ҮСТЕЛ ТЕННИСІ": "Настольный теннис", "БӘЙГЕ": "Конный спорт", "АТ СПОРТЫ": "Конный спорт", "ЖЕҢІЛ АТЛЕТИКА": "Лёгкая атлетика", "ЛЕГКАЯ АТЛЕТИКА": "Лёгкая атлетика", "MEDIA BASKET ALMATY": "Баскетбол", "КИБЕРСПОРТ": "Киберспорт", "ПАРАСПОРТ": "Параспорт",
}
WORDS_B = (("1\\4", "1/4"), ("1\\2", "1/2"), ("ҚАЙРАТ", "Кайрат"), ("Қайрат", "Кайрат"), ("АҚТӨБЕ", "Актобе"), ("Ақтөбе", "Актобе"), ("ЕРТІС", "Иртыш"), ("Ертіс", "Иртыш"), ("ҚПЛ", "КПЛ"), ("ҚАЗАҚСТАН", "Казахстан"), ("Қазақстан", "Казахстан"))
PHRASES_B = (("АТ ЖАРЫСЫ МАУСЫМЫ", "Сезон конных скачек"), ("ҚАЗАҚСТАН ЧЕМПИОНАТЫ", "Чемпионат Казахстана"), ("КАЗАХСТАН ЧЕМПИОНАТЫ", "Чемпионат Казахстана"), ("[ІI]Р[ІI]КТЕУ КЕЗЕҢ[ІI]", "Отборочный этап"), ("[ІI]Р[ІI]КТЕУ", "Отборочный этап"), ("БІРІНШІ МАТЧ", "Первый матч"), ("АЛМАТЫДАН", "Алматы"), ("ШЫМКЕНТТЕН", "Шымкент"))
RACES_B = "сезон конных скачек"


def normal_b(x: Column) -> Column:
    """Known words and phrases of the guide of strings in Russian, one space behind a dot."""
    t = reduce(lambda a, p: F.regexp_replace(a, rf"(?iu)(?<![\p{{L}}\p{{N}}_]){p[0]}(?![\p{{L}}\p{{N}}_])", p[1]), PHRASES_B, _replaced(F.coalesce(x, F.lit("")), WORDS_B))
    return F.btrim(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"\s*\.\s*", ". "), F.lit(EDGES))


def string_title(raw: Column) -> Column:
    """sport, tournament, title of a title of the guide of strings; without a sport all is title, and a season of races is both."""
    p = rf"(?iu)^({_names(SPORTS_B)})\s*\.\s*"
    say = lambda sport, tournament, title: F.struct(sport.alias("sport"), normal_b(tournament).alias("tournament"), normal_b(title).alias("title"))

    def parted(t: Column) -> Column:
        return F.struct(t.alias("t"), _known(F.regexp_extract(t, p, 1), SPORTS_B).alias("sport"), F.btrim(F.regexp_replace(t, p, ""), F.lit(EDGES)).alias("rest"))

    def told(v: Column) -> Column:
        sport, rest = v["sport"], v["rest"]
        first = F.btrim(F.split(rest, r"\.")[0])
        races = (sport == "Конный спорт") & F.lower(first).startswith(RACES_B)
        cut = bound(by_segments(rest), lambda c: say(sport, c["tournament"], c["title"]))
        return F.when(sport == "", say(F.lit(""), F.lit(""), v["t"])).when(races, say(sport, first, rest)).otherwise(cut)

    return bound(bound(normal_b(strip_live(raw)), parted), told)
