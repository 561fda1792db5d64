"""Single rules on small tables, with outcomes worked out by hand."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from airgrid.functions import clock, evidence, lexicon, text
from airgrid.operators import diff, monitor, reconcile, schedule, simulcast, verify
from airgrid.plans import adapter
from airgrid.sources import calendars, guides, html, store
from airgrid.streaming import jobs


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("now", "want"), [("2026-07-01 17:59:00", "upcoming"), ("2026-07-01 18:00:00", "live"), ("2026-07-01 20:29:00", "live"), ("2026-07-01 20:30:00", "finished")])
def test_start_is_in_and_end_is_out(spark, now, want):
    b = clock.bounds(F.lit("2026-07-01 18:00:00").cast("timestamp"), F.lit(None).cast("timestamp"), F.lit(" Футбол "))
    assert one(spark, clock.status(b["start"], b["end"], now)) == want


def test_end_rolls_one_day_once(spark):
    b = clock.bounds(F.lit("2026-07-01 23:30:00").cast("timestamp"), F.lit("2026-07-01 01:00:00").cast("timestamp"), F.lit(""))
    assert one(spark, b["end"]) == dt.datetime(2026, 7, 2, 1, 0)


@pytest.mark.parametrize(("utc", "local"), [("16:30", "21:30"), ("16:25", "21:25"), ("21:00", "02:00"), ("22:00", "03:00")])
def test_provider_clocks_become_local(spark, utc, local):
    assert one(spark, F.date_format(clock.local(F.lit(f"2026-09-12 {utc}:00").cast("timestamp")), "HH:mm")) == local


def test_clocks_with_one_digit_and_none(spark):
    assert one(spark, clock.parsed(F.lit("2026-07-01"), F.lit("9:05"))) == dt.datetime(2026, 7, 1, 9, 5)
    assert one(spark, clock.parsed(F.lit("2026-13-01"), F.lit("9:05"))) is None


def test_near_year(spark):
    d = lambda *x: F.lit(dt.date(*x))
    assert one(spark, clock.near_year(F.lit(3), F.lit(1), d(2025, 12, 30))) == dt.date(2026, 1, 3)
    assert one(spark, clock.near_year(F.lit(29), F.lit(12), d(2026, 1, 2))) == dt.date(2025, 12, 29)


def test_matching_text(spark):
    assert one(spark, text.norm_match(F.lit("Қайрат (Алматы) – «Ордабасы»!"))) == "кайрат - ордабасы"
    assert one(spark, text.norm_match(F.lit("FC Kairat"))) == "fc кайрат"
    assert one(spark, text.norm_match(F.lit(None).cast("string"))) == ""


def test_kinds_and_sides(spark):
    assert one(spark, text.participants(F.lit("Таиланд (Женщины) vs. Корея"))) == ["Таиланд", "Корея"]
    assert one(spark, text.event_kind(F.lit("Лига чемпионов. Жеребьёвка"))) == "DRAW"
    assert one(spark, text.event_kind(F.lit("Динамо-Барнаул"))) == "GENERIC"
    assert one(spark, text.englished(F.lit("Южная Корея и Корея"))) == "South Korea и Korea"


@pytest.mark.parametrize(("said", "state"), [("Бокс. Прямой эфир", "live"), ("Бокс (повтор). Прямой эфир", "not_live"), ("Бокс /LIVE", "live"), ("Ливерпуль Liverpool", "unknown"), ("", "unknown")])
def test_what_a_text_claims(spark, said, state):
    assert one(spark, evidence.classified(F.lit(said))["state"]) == state


def test_missing_flag_is_not_false(spark):
    no, null = F.lit(False), F.lit(None).cast("boolean")
    assert one(spark, evidence.is_direct(no, null, F.lit(True))) is True
    assert one(spark, evidence.is_direct(no, F.lit(False), F.lit(True))) is False
    assert one(spark, evidence.is_direct(F.lit(True), F.lit(True), F.lit(True))) is False


def test_evidence_is_not_repeated(spark):
    e = evidence.with_evidence(F.array().cast(evidence.EVIDENCE), *map(F.lit, ("m", "s", "v", "high")))
    assert one(spark, F.size(evidence.with_evidence(e, *map(F.lit, ("m", "s", "v", "high"))))) == 1


def broadcasts(spark, rows):
    names = ("ord", "channel", "date", "time", "sport", "tournament", "title", "is_live_broadcast")
    df = spark.createDataFrame([dict(zip(names, r, strict=True)) for r in rows], "ord long, channel string, date string, time string, sport string, tournament string, title string, is_live_broadcast boolean")
    return df.withColumns({"source": F.lit("guide_a"), "start_at": clock.parsed(F.col("date"), F.col("time")), "slot_end": F.lit(None).cast("timestamp")})


def test_first_listed_stays_and_past_days_show_only_what_is_on(spark):
    rows = broadcasts(spark, [
        (2, "Ch 1", "2026-07-01", "18:00", "Футбол", "", "A – B", True), (1, "ch 1", "2026-07-01", "18:00", "Футбол", "", "a - b!", True), (3, "Ch 1", "2026-06-30", "23:00", "Бокс", "", "C – D", True),
        (4, "Ch 2", "2026-06-30", "10:00", "Бокс", "", "E – F", True), (5, "Ch 2", "2026-07-01", "10:00", "", "", "Студийная программа", True), (6, "Ch 2", "2026-07-01", "12:00", "Бокс", "", "Обзор", True),
    ])
    got = {r.ord for r in schedule.visible(rows, "2026-07-01 00:30:00").collect()}
    assert got == {1, 3}
    assert {r.ord for r in schedule.visible(rows, "2026-07-01 00:30:00", "2026-06-30").collect()} == {3, 4}
    assert schedule.upcoming(rows, "2026-07-01 00:30:00", -1).count() == 0
    with pytest.raises(ValueError):
        schedule.export_rows(rows, "none")


def test_groups_are_first_fit_and_never_merge(spark):
    rows = broadcasts(spark, [
        (1, "a", "2026-07-01", "23:50", "", "", "X – Y", True), (2, "b", "2026-07-02", "00:10", "Бокс", "", "X – Y", True), (3, "c", "2026-07-02", "00:15", "Футбол", "", "X – Y", True),
        (4, "a", "2026-07-02", "00:20", "Бокс", "", "X – Y", True), (5, "d", "2026-07-02", "02:00", "", "", "X – Y", True), (6, "e", "2026-07-01", "23:50", "", "", "", True),
    ])
    assert {r.ord: r.group_ord for r in simulcast.groups(rows).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6}
    assert {(r.a, r.b) for r in simulcast.pairs(rows).collect()} == {(1, 2), (1, 3), (2, 4)}


@pytest.mark.parametrize(("slot", "event", "exact", "state", "minutes"), [("15:55", "16:00", False, "confirmed", 5), ("23:30", "16:00", False, "mismatch", -450), ("15:25", "15:25", True, "confirmed", 0), ("15:26", "15:25", True, "mismatch", -1), ("15:50", "15:40", False, "confirmed", -10), ("15:50", "15:39", False, "mismatch", -11)])
def test_slots_and_calendar(spark, slot, event, exact, state, minutes):
    rows = broadcasts(spark, [(1, "a", "2026-07-01", slot, "MMA", "", "Иванов – Петров", True), (2, "a", "2026-07-01", slot, "MMA", "", "Сидоров – Петров", True)])
    cal = spark.createDataFrame([(7, "UFC. Иванов — Петров", "", dt.datetime(2026, 7, 1, *map(int, event.split(":")))), (8, "Иванов — Петров", "Футбол", dt.datetime(2026, 7, 1, 15, 55))], "cal_ord long, cal_title string, cal_sport string, cal_start timestamp")
    matched = reconcile.mentions(rows.select("title").distinct(), cal.select("cal_title").distinct())
    got = {r.ord: r for r in reconcile.by_calendar(rows, cal, matched, exact).collect()}
    assert (got[1].state, got[1].difference, got[1].cal_ord) == (state, minutes, 7) and got[2].state == "unknown"
    out = {r.ord: r for r in reconcile.outcome(spark.createDataFrame([(r.ord, r.state) for r in got.values()], "ord long, state string")).collect()}
    assert out[1].is_live_broadcast == (state == "confirmed") and not out[2].is_sport_event


def test_nearest_pairs_are_greedy(spark):
    old = spark.createDataFrame([("i", 1, 100), ("i", 2, 200), ("j", 3, 5), ("k", 4, 9)], "identity string, ord long, start long")
    new = spark.createDataFrame([("i", 11, 210), ("i", 12, 160), ("i", 13, 500), ("j", 14, 7)], "identity string, ord long, start long")
    assert {(r.identity, r.old_ord, r.new_ord) for r in diff.paired(old, new).collect()} == {("i", 1, 12), ("i", 2, 11), ("i", None, 13), ("j", 3, 14), ("k", 4, None)}


def test_ends_move_from_fifteen_minutes_on(spark):
    t = lambda h, m: dt.datetime(2026, 7, 1, h, m)
    schema = "identity string, channel string, start timestamp, end timestamp"
    old = spark.createDataFrame([("i", "a", t(10, 0), t(12, 0)), ("i", "b", t(10, 0), t(12, 0))], schema)
    new = spark.createDataFrame([("i", "a", t(10, 0), t(12, 14)), ("i", "c", t(10, 0), t(12, 0))], schema)
    assert {(r.channel, r.field) for r in diff.channel_changes(old, new).collect()} == {("b", "channel_removed"), ("c", "channel_added")}
    later = new.withColumn("end", F.col("end") + F.expr("interval 1 minute"))
    assert ("a", "end") in {(r.channel, r.field) for r in diff.channel_changes(old, later).collect()}


@pytest.mark.parametrize(("moves", "want"), [([("a", "c", 1440), ("b", "c", 1440), ("d", "c", 1440)], True), ([("a", "c", 1440), ("b", "c", 1440)], False), ([("a", "c", 1440), ("b", "c", 1440), ("d", "e", 1440)], False), ([("a", "c", -1440), ("b", "c", -1440), ("d", "c", 1440)], False), ([("a", "c", 60), ("b", "c", 60), ("d", "c", 60)], False)])
def test_a_slip_of_one_day_is_no_news(spark, moves, want):
    assert diff.systemic_shift(spark.createDataFrame(moves, "identity string, channel string, minutes int")).first().systemic is want


@pytest.mark.parametrize(("now", "before", "failed", "want"), [(0, None, False, "warning"), (5, None, False, "ok"), (0, 3, False, "blocked"), (0, 2, False, "ok"), (1, 5, False, "blocked"), (5, 10, False, "warning"), (15, 5, False, "warning"), (9, 10, True, "error"), (0, 0, False, "ok")])
def test_anomalies(spark, now, before, failed, want):
    assert one(spark, monitor.assessed(F.lit(now), F.lit(before).cast("int"), F.lit(failed))["status"]) == want


def test_clusters_are_anchored_on_their_first(spark):
    rows = spark.createDataFrame([(1, i, t, "o", 50) for i, t in enumerate((0, 500, 900, 1200, 1100))], "q long, ord long, at long, organisation string, weight long")
    got = {r["at"]: r.cluster for r in verify.clusters(rows, ["q"]).collect()}
    assert got == {0: 0, 500: 0, 900: 900, 1100: 900, 1200: 900}


def test_consensus(spark):
    rows = spark.createDataFrame([(1, "a", 70, 10), (1, "a", 40, 10), (1, "b", 40, -30), (2, "a", 70, 0), (2, "b", 100, 31), (3, "c", 100, 5)], "q long, organisation string, weight long, difference long")
    assert {r.q: (r.confirmed, r.confidence) for r in verify.consensus(rows, ["q"]).collect()} == {1: (True, "medium"), 2: (False, "medium"), 3: (True, "medium")}


def test_domains(spark):
    name = verify.host(F.lit("https://user@WWW.Bbc.co.uk:80/x?y"))
    assert one(spark, name) == "bbc.co.uk" and one(spark, verify.base_domain(F.lit("m.sport.bbc.co.uk"))) == "bbc.co.uk"
    assert one(spark, verify.source_weight(verify.base_domain(name))) == 70 and one(spark, verify.base_domain(F.lit(""))) == "unknown"
    assert one(spark, verify.zone_hours(F.lit("news.sports.ru"))) == 3 and one(spark, verify.zone_hours(F.lit("a.kz"))) == 5 and one(spark, verify.zone_hours(F.lit("a.com"))) is None


def test_results_about_an_event(spark):
    said = F.lit("Thailand beat South Korea in Bangkok")
    assert one(spark, verify.matches(said, F.lit("Таиланд - Южная Корея"), F.lit(""))) is True
    assert one(spark, verify.matches(said, F.lit("Таиланд - Япония"), F.lit(""))) is False
    assert one(spark, verify.matches(F.lit("UEFA Champions League draw today"), F.lit("Жеребьёвка"), F.lit("Лига чемпионов УЕФА"))) is True


GUIDE_A = """<title>Guide 12.09.2026</title><a href=x><div class="badge live-badge">LIVE</div><div>22:00</div><div>Бокс. A – B</div></a>
<a href=y><span>23:30</span> Новости</a><a href=z><img src="/img/live.png">00:30 C – D</a><a href=z>00:30 C – D</a><a>no clock</a>"""


def test_guide_of_links(spark):
    got = guides.anchors(spark.createDataFrame([(1, GUIDE_A)], "page_id long, html string")).orderBy("offset").collect()
    assert [(r.time, r.title, r.is_live, r.has_badge, r.day_offset, r.next_offset) for r in got] == [("22:00", "Бокс. A – B", True, True, 0, 1410), ("23:30", "Новости", False, False, 0, 1470), ("00:30", "C – D", False, True, 1, None)]
    assert one(spark, guides.page_date(F.lit("Guide 12.09.2026 x"))) == dt.date(2026, 9, 12) and one(spark, guides.page_date(F.lit("none"))) is None


def test_live_marks_between_times(spark):
    markup = '<a>10:00</a><span class="badge live">x</span><a>11:00</a><i>LIVE</i><a>12:00</a> Liverpool <a>13:00</a>'
    assert one(spark, guides.gap_live_times(F.lit(markup))) == ["11:00", "12:00"]
    assert one(spark, guides.live_times(F.lit("LIVE  10:00 x LIVE 25:00 y LIVE 09:30"))) == ["09:30", "10:00"]


GUIDE_B = "<b>Пн 31.12</b><b>Вт 01.01</b><p>07:00</p><p>ҚР Әнұраны</p><p>23:30</p><p>▶</p><p>A – B</p><p>00:30</p><p>C – D</p><p>07:00</p><p>ҚР Әнұраны</p><p>08:00</p><p>09:00</p><p>E – F</p>"


def test_guide_of_strings(spark):
    got = guides.string_rows(spark.createDataFrame([(1, GUIDE_B)], "page_id long, html string"), "page_id", "html", "2025-12-31").orderBy("ord").collect()
    assert [(str(r.date), r.time, r.title) for r in got] == [("2025-12-31", "07:00", "ҚР Әнұраны"), ("2025-12-31", "23:30", "A – B"), ("2026-01-01", "00:30", "C – D"), ("2026-01-01", "07:00", "ҚР Әнұраны"), ("2026-01-01", "09:00", "E – F")]


def test_provider_json(spark):
    e = lambda t, b, d="": {"title": t, "eventDescriptionMedium": d, "scheduledFor": {"begin": b, "end": "2026-09-13T01:00:00Z"}}
    body = json.dumps({"pages": [{"events": [e(" Бокс  x ", "2026-09-12T23:30:00Z", "Прямой эфир"), e("Бокс x", "2026-09-12T23:30:00Z"), e("y", "2026-09-13T00:30:00Z")]}]})
    got = guides.epg_rows(spark.createDataFrame([("c", "2026-09-12", body), ("d", "2026-09-12", "not json")], "channel string, date string, body string")).collect()
    assert [(r.channel, r.time, r.raw_title, r.live_state) for r in got] == [("c", "23:30", "Бокс x", "live")]
    t = one(spark, guides.tournament_and_title(F.lit("Кубок мира: A - B")))
    assert (t.tournament, t.title) == ("Кубок мира", "A - B")


CALENDAR = """# Футбол
[Лига 1](http://x)
* 22:00 **A — B** Не начался
* 01.01 00:30 C – D 2:1 (1:0)
* 23:00 Динамо-Барнаул Окончен
Лига 2
* 22:00 a — b Не начался
## Биатлон
* 12:00 Спринт Перенесён
* 13:00 Гонка
"""


def test_calendar_text(spark):
    got = calendars.calendar_rows(spark.createDataFrame([(1, CALENDAR)], "id long, body string"), "id", "body", F.lit("2026-12-31").cast("date")).orderBy("start_at").collect()
    assert [(str(r.start_at), r.sport, r.tournament, r.title, r.status) for r in got] == [("2026-12-31 14:00:00", "Биатлон", "", "Спринт", "Перенесён"), ("2027-01-01 00:00:00", "Футбол", "Лига 1", "A — B", "Не начался"), ("2027-01-01 02:30:00", "Футбол", "Лига 1", "C – D", None)]


def test_signature_is_blind_to_markup(spark):
    pages = spark.createDataFrame([(1, "<p class=live>10:00</p> <p>x</p><script>1</script>"), (2, "<p>10:00</p><p> x </p>"), (3, "<p>10:01</p><p>x</p>")], "id long, html string")
    got = {r.id: r.signature for r in html.signature(pages, "id", "html").collect()}
    assert got[1] == got[2] != got[3]


def test_a_change_must_be_seen_twice():
    state, seen = None, []
    for s in "aabacbccab":
        state, served = jobs.settle(state, s)
        seen.append((state[0], served))
    assert "".join(x[0] for x in seen) == "aaaaaaaccc"
    assert [x[1] for x in seen] == [True, True, False, True, False, False, False, True, False, False]


def test_upsert_keeps_first_sight(spark):
    old = spark.createDataFrame([("x", "s", "d", "t1", "t1", "r1"), ("y", "s", "d", "t1", "t1", "r1")], "storage_id string, source string, scope_date string, first_seen string, last_seen string, run string")
    new = spark.createDataFrame([(1, "x", "s", "d"), (2, "z", "s", "d"), (3, "z", "s", "e")], "ord long, storage_id string, source string, scope_date string")
    got = {r.storage_id: (r.scope_date, r.first_seen, r.last_seen, r.active) for r in store.upserted(old, new, "r2", "t2").collect()}
    assert got == {"x": ("d", "t1", "t2", True), "y": ("d", "t1", "t1", False), "z": ("e", "t2", "t2", True)}


def test_versions(spark, tmp_path):
    for v in (1, 2):
        store.append(spark.range(v), str(tmp_path / "t"), v)
    assert store.latest(spark, str(tmp_path / "t")).count() == 2


def test_messages_are_packed_in_order(spark):
    lines = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate((5, 5, 20, 3))], "k long, ord long, text string")
    assert [len(r.body) for r in schedule.packed(lines, ["k"], 12).orderBy("message").collect()] == [12, 20, 3]


def test_word_lists_are_whole():
    assert len(lexicon.EDITORIAL_MARKERS) == 30 and len(lexicon.SPORT_MARKERS) == 29 and len(lexicon.SPORT_HINTS) == 22 and len(lexicon.DURATIONS) == 13 and len(lexicon.ALIASES) == 54


def test_systemic_shift_sees_the_whole_diff(spark, sf):
    from airgrid.plans import joined

    got = joined.systemic_shift_whole(spark, sf).collect()[0]
    assert got.n == joined.channel_diff(spark, sf).where("field = 'time'").count() > joined.systemic_shift(spark, sf).collect()[0].n and not got.systemic


def test_message_packing_packs_all_rows(spark, sf):
    from airgrid.plans import adapter, scanned

    rows = adapter.bx(spark, sf).select("source", "date", "time", "channel", "title").collect()
    got = scanned.message_packing(spark, sf).collect()
    assert {(r.source, r.date) for r in got} == {(r.source, r.date) for r in rows}
    assert sum(r.n_chars for r in got) == sum(len(f"{r.time} {r.channel} {r.title}") for r in rows) + 2 * (len(rows) - len(got))


SAID = [
    ("Kick-off 2026-09-12 at 15:30 UTC", None, [("2026-09-12 15:30", True, True)]),
    ("12.09.2026 в 18:30 МСК", None, [("2026-09-12 15:30", True, False)]),
    ("2026-01-12 15:30 EST", None, []),  # an American clock without am or pm is none
    ("Main card 9:00 PM ET on September 12, 2026", None, [("2026-09-13 01:00", True, True)]),
    ("9 pm est, 12 January 2026", None, [("2026-01-13 02:00", True, False)]),
    ("2026-06-01 10:00 pm CEST", None, []),  # a Central European one with pm neither
    ("2026-06-01 20:00 CEST", None, [("2026-06-01 18:00", True, False)]),
    ("12 September 2026", "Europe/Moscow", [("2026-09-12 09:00", False, False)]),  # bare numbers are clocks of the page's zone
    ("Sept 3, 2026 starts 19:00", "America/New_York", [("2026-09-03 07:00", False, True), ("2026-09-03 23:00", False, True)]),
    ("сентябрь 3 2026, 10:61", "Asia/Almaty", [("2026-09-02 22:00", False, False)]),
    ("19:00 UTC", None, []),  # no date
]


@pytest.mark.parametrize(("said", "home", "want"), SAID)
def test_clocks_of_pages(said, home, want):
    from airgrid.operators import occurrence

    assert [(f"{at:%Y-%m-%d %H:%M}", zone, cue) for at, zone, cue in occurrence.clocks_in(said, home)] == want


def test_dates_of_pages():
    from airgrid.operators import occurrence

    found = occurrence.dates_in("1.02.03.2024, 2024-13-01, 31/12/2023 and 5th; May 5th, 2024; 7 мая 2024; 2024-05-07 again")
    assert [(str(d), at) for d, at in found] == [("2023-12-31", 26), ("2024-03-02", 2), ("2024-05-05", 46), ("2024-05-07", 61)]


def test_names_in_other_letters_and_languages(spark):
    said = F.lit("Kairat beat Orleu; draw: UEFA Champions League")
    assert one(spark, text.aliases(F.lit("Қайрат"))) == ["қайрат", "кайрат", "kairat"]
    assert one(spark, text.participants(F.lit("1/4 финала: Қайрат – Өрлеу (U19)"))) == ["Қайрат", "Өрлеу"]
    e = F.lit("")
    assert one(spark, verify.matches(F.lit("кайрат орлеу"), F.lit("1\\4 финал. Қайрат – Өрлеу"), e)) is True
    assert one(spark, verify.matches(said, F.lit("Жеребьёвка"), F.lit("Лига чемпионов УЕФА"))) is True
    assert one(spark, verify.matches(said, F.lit("Жеребьёвка"), e)) is False
    assert one(spark, verify.matches(F.lit("Tour de France stage"), F.lit("Tour de France"), e)) is True
    assert one(spark, verify.relaxed(F.lit("news of the Premier League"), F.lit("A – B"), F.lit("английская премьер-лига"), e)) is True
    assert one(spark, verify.relaxed(F.lit("nothing"), F.lit("A – B"), e, e)) is False


def test_first_fit_looks_back_half_an_hour_only(spark):
    """A title that is never silent: every group takes what is near its last broadcasts, none grows over its old ones."""
    rows = broadcasts(spark, [(i, "abc"[i % 3], "2026-07-01", f"{8 + i // 6:02d}:{i % 6 * 10:02d}", "", "", "X – Y", True) for i in range(60)])
    got = {r.ord: r.group_ord for r in simulcast.groups(rows).collect()}
    assert set(got.values()) == {0}  # each is within ten minutes of another channel's
    far = broadcasts(spark, [(0, "a", "2026-07-01", "08:00", "", "", "X – Y", True), (1, "a", "2026-07-01", "08:20", "", "", "X – Y", True), (2, "b", "2026-07-01", "08:31", "", "", "X – Y", True), (3, "c", "2026-07-01", "08:50", "", "", "X – Y", True)])
    assert {r.ord: r.group_ord for r in simulcast.groups(far).collect()} == {0: 0, 1: 1, 2: 1, 3: 1}
