"""What is walked in order: runs, first fit, nearest pairs, debounce, replays, messages; against plain Python on random rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from airgrid.operators import diff, ordered, schedule, simulcast
from airgrid.streaming import jobs


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_runs_go_on_over_partitions(spark, parts):
    """However rows are spread, a run begins where a key or a gap does."""
    rng = random.Random(parts)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.randrange(2000), i) for i in range(600)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = ordered.runs(spark.createDataFrame(rows, "k string, t long, i long"), "k", "t", "i", 5).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want, before, run = {}, None, None
    for k, t, i in sorted(rows):
        if before is None or k != before[0] or t - before[1] > 5:
            run = i
        before, want[i] = (k, t), run
    assert {r.i: r.run for r in got} == want and len(got) == len(rows)


def first_fit(rows):
    groups, out = [], {}
    for ord_, channel, t, sport in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        fits = next((g for g in groups if any(c != channel and abs(t - u) // 60 <= 30 and (not s or not sport or s == sport) for c, u, s in g[1])), None)
        if fits is None:
            groups.append(fits := (ord_, []))
        fits[1].append((channel, t, sport))
        out[ord_] = fits[0]
    return out


def listed(spark, rows):
    made = spark.createDataFrame(rows, "ord long, channel string, t long, sport string").withColumn("start_at", F.timestamp_seconds("t"))
    return made.select("ord", "channel", "sport", F.lit("").alias("tournament"), F.lit("X – Y").alias("title"), "start_at", F.date_format("start_at", "yyyy-MM-dd").alias("date"), F.date_format("start_at", "HH:mm").alias("time"))


@pytest.mark.parametrize("spread", [2_000, 20_000, 200_000])
def test_first_fit_of_one_title(spark, spread):
    """Rows of one title on several channels, from never silent to mostly so."""
    rng = random.Random(spread)
    rows = [(i, rng.choice("abcd"), 60 * rng.randrange(spread // 60 + 1), rng.choice(["", "s", "t"])) for i in range(150)]
    assert {r.ord: r.group_ord for r in simulcast.groups(listed(spark, rows)).collect()} == first_fit(rows)


def test_a_title_that_is_never_silent_is_held_for_half_an_hour_only(spark):
    """60,000 broadcasts a minute apart: what a row may join is what is recent, so this takes seconds and no memory to speak of."""
    rows = spark.range(60_000).select(F.col("id").alias("ord"), F.concat(F.lit("c"), F.col("id") % 7).alias("channel"), F.lit("").alias("sport"), F.lit("").alias("tournament"), F.lit("X – Y").alias("title"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("start_at"))
    rows = rows.withColumns({"date": F.date_format("start_at", "yyyy-MM-dd"), "time": F.date_format("start_at", "HH:mm")})
    got = simulcast.groups(rows).agg(F.count("*").alias("n"), F.count_distinct("group_ord").alias("groups")).first()
    assert (got.n, got.groups) == (60_000, 1)


def greedy(olds, news):
    left, out = sorted(news), []
    for s, o in sorted(olds):
        best = min(left, key=lambda x: (abs(x[0] - s), x[0], x[1]), default=None)
        out.append((o, best and best[1]))
        if best:
            left.remove(best)
    return out + [(None, o) for _, o in left]


@pytest.mark.parametrize("seed", range(40))
def test_nearest_left_is_the_greedy_list(seed):
    rng = random.Random(seed)
    span = rng.choice([5, 30, 1000])
    side = lambda n, at: [(rng.randrange(span), at + i) for i in range(n)]
    olds, news = side(rng.randrange(15), 0), side(rng.randrange(15), 100)
    assert diff.nearest_left(sorted(olds), sorted(news)) == greedy(olds, news)


def test_pairs_of_identities_cut_into_runs(spark):
    """The same pairs whether an identity is taken whole or walked in runs: rows that stay, move, come and go, near and far."""
    rng = random.Random(11)
    old, new = [], []
    for k in range(60):
        for _ in range(rng.randrange(12)):
            at = rng.randrange(40) * rng.choice([1, 10, 100])
            if rng.random() < 0.9:
                old.append((f"i{k}", len(old), at))
            if rng.random() < 0.9:
                new.append((f"i{k}", 10_000 + len(new), at + rng.choice([0, 0, 0, 1, -3, 25])))
    frame = lambda rows: spark.createDataFrame(rows, "identity string, ord long, start long")
    want = []
    for k in {r[0] for r in old + new}:
        want += [(k, *p) for p in greedy([(s, o) for i, o, s in old if i == k], [(s, o) for i, o, s in new if i == k])]
    got = [tuple(r) for r in diff.paired(frame(old), frame(new)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_runs_of_a_popular_identity_are_short():
    """An event that is told every day, hardly changed, is held a day at a time."""
    run, most = diff._Run("i"), 0
    for day in range(1000):
        for side in (0, 1):
            list(run.take(day * 86_400 + side * 1_200, day, side))
            most = max(most, sum(map(len, run.sides)))
    assert most == 2


def test_debounce_over_restarts(spark, tmp_path):
    """Observations that land in three parts, with a stop between, are one fold a source; a batch is sorted, whatever its files are."""
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", "hot", "hot"]), i, rng.choice("aab")) for i in range(300)]
    state, want = {}, {}
    for source, i, seen in rows:
        state[source], served = jobs.settle(state.get(source), seen)
        want[source, i] = (state[source][0], served)
    for a in range(0, 300, 100):
        part = rows[a : a + 100]
        rng.shuffle(part)
        spark.createDataFrame(part, "source string, ord long, signature string").repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("source string, ord long, signature string").parquet(f"{tmp_path}/in")
        got = jobs.debounced(stream, f"{tmp_path}/out")
    assert {(r.source, r.ord): (r.stable, r.served) for r in got.collect()} == want


def test_replays_are_told_by_load(spark, tmp_path):
    """Within a load the first in order is none, whatever order its rows land in; each load begins anew."""
    rng = random.Random(4)
    seen, want = set(), {}
    for load in (1, 2, 3):
        rows = [(load, f"{i:03d}", load * 100 + i, rng.choice("ab"), rng.choice(["Матч ", "матч", "Обзор"])) for i in range(40)]
        for _, _, o, c, t in rows:
            key = (load, c, t.strip().lower())
            want[o] = key in seen
            seen.add(key)
        rng.shuffle(rows)
        spark.createDataFrame(rows, "load long, place string, ord long, channel string, title string").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("load long, place string, ord long, channel string, title string").parquet(f"{tmp_path}/in")
        got = jobs.run_once(jobs.replay_flags(stream), f"{tmp_path}/out")
    assert {r.ord: r.repeated for r in got.collect()} == want


def test_views_repeat_the_header(spark):
    heads = spark.createDataFrame([(1, "HEAD", "|foot"), (2, "HEAD", "|foot"), (3, "HEAD", None)], "k long, header string, footer string")
    blocks = spark.createDataFrame([(1, 1, "x" * 5), (1, 2, "y" * 5), (1, 3, "z" * 30), (1, 4, "w"), (3, 1, "v")], "k long, ord long, text string")
    got = {(r.k, r.message): r.body for r in schedule.views(heads, blocks, ["k"], 20).collect()}
    assert got == {(1, 0): "HEAD\n\nxxxxx\n\nyyyyy", (1, 1): "HEAD\n\n" + "z" * 30, (1, 2): "HEAD\n\nw|foot", (2, 0): "HEAD\n\nСобытий нет.|foot", (3, 0): "HEAD\n\nv"}
