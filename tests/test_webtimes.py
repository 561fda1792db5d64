"""Windows, clocks and scores in texts of results and pages, by hand."""

import pytest

from airgrid.operators import webtimes


def test_windows_merge_and_fall_back():
    text = "x" * 1000 + "Кайрат" + "y" * 40 + "КАЙРАТ" + "z" * 3000 + "Kairat" + "w" * 10
    got = webtimes.windows_in(text, ["kairat", "кайрат"])
    # the longest first, of equally long ones as sorted by the caller; the second place hardly differs but for its grain
    assert got[0] == (len(text) - 16 - 500, len(text), "kairat")
    assert got[1] == (500, 1506, "кайрат") and len(got) == 2 + ((546 // 100, 1552 // 100) != (500 // 100, 1506 // 100))
    assert webtimes.windows_in("a" * 9000, ["кайрат"]) == [(0, 6000, "")]
    assert webtimes.windows_in("", ["кайрат"]) == []


@pytest.mark.parametrize(
    "said, zoned, want",
    [
        ("19:30 UTC", False, [(1170, "UTC", 100)]),
        ("7:30:15 pm GMT", False, [(1170, "UTC", 100)]),
        ("19:30 UTCX", True, []),  # stands before letters that begin like a zone: neither with nor without one
        ("22:30 МСК, начало", True, [(1350, "MSK", 100 + 180 - 2)]),
        ("22:30 Moscow time", True, [(1350, "MSK", 156)]),  # its own "time" is a word beside it, four characters from its end
        ("22:30", False, []),
        ("22:30", True, [(1350, "local", 0)]),
        ("starts 7 pm", True, [(1140, "local", 179)]),
        ("starts 7 pmx", True, []),
        ("12:30 am", True, [(30, "local", 0)]),
        ("13:30 am", True, []),
        ("24:00", True, []),
        ("12:60 UTC", True, []),
        ("1:12:30", True, [(72, "local", 0)]),
        ("schedule: 10:00. " + "." * 120 + " kick-off", True, [(600, "local", 60 - 2)]),
        ("kick-off" + " " * 119 + "10:00", True, [(600, "local", 61)]),
        ("kick-off" + " " * 121 + "10:00", True, [(600, "local", 0)]),
    ],
)
def test_clocks(said, zoned, want):
    assert list(webtimes.clocks_in(said, zoned)) == want


def test_a_time_counts_once_with_its_best_score():
    said = "Kairat 10:00 UTC " + "." * 700 + " Kairat kick-off 10:00 UTC, 13:00 MSK"
    got = webtimes.times_in(said, ["Kairat"], False)
    assert [(at, zone, worth) for _, at, zone, worth in got] == [(600, "UTC", 279), (780, "MSK", 100 + 180 - 12)]
    assert [t[0] for t in got] == [0, 2]
    assert webtimes.best_of(got) == [(0, 600, "UTC", 279)]


def test_a_stated_zone_wins_over_any_score():
    got = webtimes.times_in("Kairat starts 10:00. Later 18:00 UTC", ["Kairat"], True)
    assert webtimes.best_of(got)[0][1:3] == (1080, "UTC") and webtimes.best_of([]) == []


@pytest.fixture(scope="module")
def told(spark):
    """Slots at 19:00 in Almaty (13:00 UTC) and results about them."""
    events = [(i, "Кайрат – Андерлехт", "Лига", "Футбол", "2024-01-15 19:00:00") for i in range(1, 9)]
    events = spark.createDataFrame(events, "event long, title string, tournament string, sport string, start_at string").selectExpr("event", "title", "tournament", "sport", "timestamp(start_at) as start_at")
    both = "Kairat v Anderlecht "
    rows = [
        (1, 0, 0, "http://uefa.com/a", both + "kick-off 13:05 UTC"),
        (2, 0, 0, "http://uefa.com/a", both + "kick-off 13:25 UTC"),
        (3, 0, 0, "http://uefa.com/a", both + "kick-off 14:00 UTC"),
        (4, 0, 0, "http://uefa.com/a", both + "soon"),
        (5, 0, 0, "http://uefa.com/a", "Astana v Tobol 13:00 UTC"),
        # two voices of 40 outweigh one of 70 at another time
        (6, 0, 0, "http://one.example.com/", both + "13:00 UTC"), (6, 1, 0, "http://two.example.net/", both + "13:05 UTC"), (6, 2, 0, "http://sports.ru/", both + "15:00 UTC"),
        # the second search is heard where the first found nothing about the event
        (7, 0, 0, "http://uefa.com/a", "Astana v Tobol 13:00 UTC"), (7, 1, 1, "http://baidu.com/", both + "21:00"),
        (8, 0, 0, "http://uefa.com/p", both + "kick-off 14:00 UTC"), (8, 1, 1, "http://baidu.com/", both + "21:00"),
    ]
    results = spark.createDataFrame([(e, p, t, p + 1, u, "", s) for e, p, t, u, s in rows], "event long, place int, tier int, rank int, url string, title string, snippet string")
    pages = spark.createDataFrame([("http://uefa.com/p", None, "UEFA", both + " begins at 13:00 GMT" + "." * 300)], "url string, page_url string, page_title string, content string")
    return {r.event: r for r in webtimes.verified(events, results, pages).collect()}


def test_verdicts(told):
    short = {k: (r.state, r.method, r.difference, r.organisations, r.weight, r.confidence, r.agreement, r.matching) for k, r in told.items()}
    assert short[1] == ("verified", "search_snippet", 5, 1, 100, "medium", "agrees", 1)
    assert short[2] == ("verified", "search_snippet", 25, 1, 100, "medium", "differs", 1)
    assert short[3] == ("rejected", "search_snippet", 60, 0, 0, None, None, 1)
    assert short[4] == ("no_time", "none", None, 0, 0, None, None, 1)
    assert short[5] == ("none", "none", None, 0, 0, None, None, 0)
    assert short[6] == ("verified", "search_snippet", 0, 2, 80, "medium", "agrees", 3)
    assert short[7] == ("verified", "search_snippet", 0, 1, 40, "low", "agrees", 1)  # 21:00 in China
    assert (told[7].n_results, told[8].n_results, told[8].n_read) == (2, 1, 1)
    # the page has the snippet's time as well; both are stated plainly, the first read of equal scores speaks
    assert told[8].method == "page_extract"


def test_cues_in_all_forms_of_their_first_letter():
    """A cue's first letter is looked for by its forms; they are those that the pattern engine takes for equal."""
    import re

    for letter, forms in webtimes.FORMS.items():
        assert set(re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), forms)) == {chr(c) for c in range(0x20000) if re.fullmatch(letter, chr(c), re.I)}
    assert webtimes.CUES[0][0].search("KICK OFF") and webtimes.CUES[0][0].search("НАЧНЁТСЯ") and webtimes.CUES[1][0].match("Scheduled")[0] == "Scheduled"


def test_clocks_are_looked_for_at_colons_only():
    """As by a search through the whole window, in order and without overlap."""
    for said in ("1:12:30", "12:30:45:10 UTC", "112:30 GMT", ":30", "7:5", "23:59 pm GMT 3:00", "10:00 UTC11:00 UTC", "7 pm 8:00 am", "Team 7 am", "١٢:٣٠ UTC"):
        for k, (_, pattern) in enumerate(webtimes.CLOCKS):
            assert [m.span() for m in webtimes._told(pattern, said, k == webtimes.HALVES)] == [m.span() for m in pattern.finditer(said)]


def test_broadcasts_of_one_question_are_asked_about_together(spark):
    """Two broadcasts of one number: what is found for either speaks for both, one page of an organisation is read, each slot has its own difference."""
    events = spark.sql("select * from values (2L, 1L, 'Кайрат – Андерлехт', 'Лига', 'Футбол', timestamp '2024-01-15 19:00:00'), (3L, 1L, 'ТОБОЛ – АСТАНА', 'Лига', 'Футбол', timestamp '2024-01-15 19:10:00'), (4L, 2L, 'Кайрат – Андерлехт', 'Лига', 'Футбол', timestamp '2024-01-15 19:00:00') v(event, question, title, tournament, sport, start_at)")
    rows = [(2, "http://uefa.com/2", "Kairat v Anderlecht 13:05 UTC"), (3, "http://uefa.com/3", "Тобол – Астана, скоро"), (3, "http://news.sports.ru/3", "Kairat v Anderlecht 15:00 UTC")]
    results = spark.createDataFrame([(e, p, 0, p + 1, u, "", s) for p, (e, u, s) in enumerate(rows)], "event long, place int, tier int, rank int, url string, title string, snippet string")
    pages = spark.createDataFrame([(u, None, "", "at 13:05 UTC") for _, u, _ in rows], "url string, page_url string, page_title string, content string")
    got = {r.event: (r.state, r.difference, r.organisations, r.matching, r.n_results, r.n_read) for r in webtimes.verified(events, results, pages).collect()}
    assert got == {2: ("verified", 5, 1, 2, 3, 1), 3: ("verified", -5, 1, 2, 3, 1), 4: ("none", None, 0, 0, 0, 0)}


def test_a_text_is_normalised_once_for_all_names(spark):
    import re

    from airgrid.sources.shared import settled

    events = spark.sql("select 1L as event, 'Кайрат – Андерлехт' as title, 'Лига' as tournament, 'Футбол' as sport, timestamp '2024-01-15 19:00:00' as start_at")
    results = spark.sql("select 1L as event, id as place, 'http://uefa.com/' as url, concat('x', id) as title, concat('Kairat v Anderlecht ', id) as snippet from range(3)")
    told = webtimes.matching(settled(webtimes.named(events), "events"), results)
    assert told.count() == 3
    assert len(re.findall(r"lower\((?:said|concat_ws)", told._jdf.queryExecution().optimizedPlan().toString())) == 1
