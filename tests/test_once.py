"""What is dear is worked out once: a page is read once, whatever is asked of it."""

from airgrid.plans import registry

QUERIES = registry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_read_once_for_the_site_and_all_others(spark, sf):
    got = QUERIES["site_first_verdict"](spark, sf)
    assert "MapInArrow" not in plan(got)  # what pages tell is stored by then
    assert got.count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_an_organisation_near_and_one_far(spark):
    """Both come from one pass over the times: the far one counts as nearest only, the near one speaks."""
    from airgrid.operators import occurrence

    slots = spark.sql("select 1L as ord, timestamp '2024-01-01 10:00:00' as start_at union all select 2L, timestamp '2024-01-01 10:00:00' union all select 3L, timestamp '2024-01-01 10:00:00'")
    found = spark.sql("select ord, timestamp '2024-01-01 10:00:00' + make_interval(0, 0, 0, 0, 0, m) as at, w as weight, 0 as score, o as organisation from values (1L, 20, 70, 'b'), (1L, 10, 70, 'a'), (1L, 600, 100, 'c'), (2L, 90, 100, 'c'), (2L, -80, 40, 'a') v(ord, m, w, o)")
    got = occurrence.verdicts(slots, found, ["ord"], sources=True).orderBy("ord").collect()
    assert [(r.state, r.difference, r.organisations, r.domains) for r in got] == [("confirmed_direct", 10, 2, ["a", "b"]), ("mismatch", -80, 0, ["a"]), ("unknown", None, 0, [])]


def test_texts_are_made_once(spark):
    """One look for each different text, nulls among them; every row is there, and no other."""
    from pyspark.sql import functions as F

    from airgrid.operators import texts

    rows = spark.sql("select id, case id % 3 when 0 then 'a' when 1 then 'b' end as x, id % 2 as y from range(12)")
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def dear(x, y):
        asked.add(1)
        return f"{x}{y}"

    got = texts.made_once(rows, ["x", "y"], {"z": dear("x", "y")})
    assert sorted(map(tuple, got.collect())) == sorted((r.id, r.x, r.y, f"{r.x}{r.y}") for r in rows.collect())
    assert asked.value == 6


def test_titles_are_shown_once_for_each_text(spark, sf):
    assert "regexp" not in plan(QUERIES["display_titles"](spark, sf)).lower()


def test_a_providers_lines_are_parted_once_for_each_text(spark, sf):
    told = plan(QUERIES["epg_projected"](spark, sf)).lower()
    assert "regexp_extract" not in told and "contains(" not in told


def test_a_row_is_not_held_against_all_before_it(spark, sf, monkeypatch):
    """Many broadcasts of a title at once: those of one channel fit no group, those of another the first."""
    from airgrid.operators import simulcast

    asked = []
    fits = simulcast._Heard.fits
    monkeypatch.setattr(simulcast._Heard, "fits", lambda self, *of: asked.append(1) or fits(self, *of))
    walk = simulcast._Walk("title")
    for i in range(3000):
        walk.forget(i // 100, 30)
        assert walk.join(i, i // 100, "a", "s", "") == i
    assert walk.join(3000, 30, "b", "", "t") == 0
    assert len(asked) < 3010
    walk.forget(31 * 60 + 30, 30)
    assert not walk.groups and not walk.recent and not walk.all.n
    assert "regexp" not in plan(QUERIES["simulcast_pairs"](spark, sf)).lower()


def test_pages_are_read_once_for_dates_and_clocks(spark, sf):
    assert "MapInArrow" not in plan(QUERIES["occurrence_dates"](spark, sf))


def test_months_are_whole_words():
    from airgrid.operators import occurrence

    said = "mayor 5 2024, May 5 2024, 7_may 2024, 8may 2024, SEPT 9, 2024, септября 3 2024, 4 марта 2024"
    assert [str(d) for d, _ in occurrence.dates_in(said)] == ["2024-03-04", "2024-05-05", "2024-09-09"]


def test_names_are_put_into_english_once_and_dates_left(spark, sf):
    """As before, when the whole line was put into English: with nulls, empty texts and a name at the end."""
    from pyspark.sql import functions as F

    from airgrid.functions import text
    from airgrid.operators import verify

    assert "regexp" not in plan(QUERIES["query_strings"](spark, sf)).lower()
    rows = spark.sql("select * from values (1, 'Қайрат –  Андерлехт', 'Лига 1', '', timestamp '2024-05-01 10:00:00'), (2, '', null, '', timestamp '2024-11-30 10:00:00'), (3, 'Россия', '1/2', 'финал', null), (4, null, 'Серия А', 'Лига', timestamp '2024-01-09 10:00:00') v(ord, title, tournament, sport, start_at)")
    whole = F.btrim(text.englished(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("title", "tournament", "sport")), F.date_format("start_at", "MMMM dd yyyy"))))
    got = {r.ord: (r.first, r.second) for r in verify.query_strings(rows).collect()}
    assert got == {r.ord: (r.first, f"{r.first} start time schedule") for r in rows.select("ord", whole.alias("first")).collect()}
    assert got[1][0] == "Kairat – Anderlecht Ligue 1 May 01 2024" and got[2][0] == "November 30 2024"


def test_equal_pages_are_read_once(spark, monkeypatch):
    """One look for each different text and zone, whatever sites say it; rows are those of the texts, with nulls, empty pages and pages that state nothing."""
    from airgrid.operators import occurrence, texts

    asked, settled = [], texts.settled
    monkeypatch.setattr(texts, "settled", lambda df, name: asked.append(settled(df, name)) or asked[-1])
    said = ["May 5 2024 or 06/05/2024, kick-off 18:30 UTC", "2024-05-05 at 21:30", "nothing of a date, 18:30 UTC", "", None]
    urls = ["https://news.sports.ru/a", "https://www.uefa.com/m/", "https://example.com/", None]
    rows = spark.createDataFrame([(i, urls[i % 4], said[i % 5]) for i in range(400)], "ord long, url string, said string")
    found = sorted(occurrence.told(rows).collect(), key=str)
    assert [df.count() for df in asked] == [8]  # four texts (null is empty) in Moscow's zone and in none
    zones, names = ["Europe/Moscow", None, None, None], ["sports.ru", "uefa.com", "example.com", "unknown"]
    want = []
    for i in range(400):
        text = said[i % 5] or ""
        stated = occurrence.dates_in(text)
        want += [(i, names[i % 4], d, None, None, None) for d, _ in stated] + [(i, names[i % 4], None, *c) for c in occurrence.clocks_in(text, zones[i % 4], stated)]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str) and len(want) > 400


def test_no_python_on_every_page(spark, sf):
    told = plan(QUERIES["dated_candidates"](spark, sf)).lower()
    assert "mapinarrow" not in told and "python" not in told


def test_slots_are_not_sent_to_all(spark, sf):
    """Slots are as many as events, so a broadcast of them does not fit at any size."""
    for name, n in (("occurrence_dates", 2), ("site_first_verdict", 4)):
        assert plan(QUERIES[name](spark, sf)).count("strategy=merge") == n


def test_a_guide_of_strings_is_read_once(spark, sf):
    """Its strings and its titles are stored by the time they are asked for; a blinking item needs its page once more."""
    told = plan(QUERIES["guide_b_scan"](spark, sf)).lower()
    assert "mapinarrow" not in told and "regexp" not in told
    assert plan(QUERIES["guide_b_complete"](spark, sf)).count("MapInArrow") == 1


def test_a_title_of_strings_is_normalised_once(spark):
    """A title's parts are worked out from one normal form, not each from its own."""
    from pyspark.sql import functions as F

    from airgrid.functions import titles

    said = spark.createDataFrame([("ФУТБОЛ. ҚПЛ . Қайрат – Ертіс. Тікелей эфир",), ("АТ СПОРТЫ. АТ ЖАРЫСЫ МАУСЫМЫ. 3 күн",), ("Новости",), (None,), ("БОКС.",)], "x string")
    got = said.select("x", titles.string_title(F.col("x")).alias("t")).select("x", "t.*")
    assert [tuple(r)[1:] for r in got.collect()] == [("Футбол", "КПЛ", "Кайрат – Иртыш"), ("Конный спорт", "Сезон конных скачек", "Сезон конных скачек. 3 күн"), ("", "", "Новости"), ("", "", ""), ("", "", "БОКС")]
    assert plan(said.select(titles.string_title(F.col("x")).alias("t"))).count("прямая трансляция") == 1
