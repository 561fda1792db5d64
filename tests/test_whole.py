"""Whole jobs and keys that meet: every user has every day, and two broadcasts of one number stay two."""

import shutil
from pathlib import Path

import duckdb
import pytest

from airgrid.plans import registry
from test_queries import comparable

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def test_every_user_has_a_slot_on_every_day(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("user_id", "to_date(ts) as day")
    assert QUERIES["verify_verdict"](spark, sf).count() == events.select("user_id").distinct().count() * events.select("day").distinct().count()


@pytest.fixture(scope="module")
def meeting(spark, sf, tmp_path_factory):
    """Events whose numbers meet those of repeated broadcasts, which are a million on."""
    out = tmp_path_factory.mktemp("meeting")
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_id < 120")
    e.unionByName(e.withColumn("event_id", e.event_id + 1000000)).coalesce(1).write.parquet(str(out / "events.parquet"))
    for f in Path(sf).iterdir():
        if f.name != "events.parquet":
            shutil.copy(f, out / f.name)
    return str(out)


@pytest.mark.parametrize("name", ["extracted_times", "collected_candidates", "calendar_reconcile_texts"])
def test_numbers_that_meet(spark, meeting, name):
    db = duckdb.connect()
    db.sql("set timezone = 'UTC'")
    db.sql(f"create view events as select * from read_parquet('{meeting}/events.parquet/*.parquet')")
    assert comparable(QUERIES[name](spark, meeting).toPandas()) == comparable(db.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", ["verify_from_texts", "verdict_texts"])
def test_each_broadcast_of_a_number_has_its_own_verdict(spark, meeting, tmp_path, name):
    e = spark.read.parquet(f"{meeting}/events.parquet")
    alone = []
    for part in ("event_id < 1000000", "event_id >= 1000000"):
        folder = tmp_path / part[9:11].strip("= ")
        e.where(part).coalesce(1).write.parquet(str(folder / "events.parquet"))
        alone += QUERIES[name](spark, str(folder)).toPandas().astype(str).values.tolist()
    assert sorted(QUERIES[name](spark, meeting).toPandas().astype(str).values.tolist()) == sorted(alone)


def test_no_day_is_gone_through_anew_for_each_row(spark):
    from airgrid.operators import reconcile

    slots = spark.sql("select 1L as ord, 'a' as title, 'c' as tournament, 's' as sport, timestamp '2024-01-01 10:00:00' as start_at union all select 1L, 'b', 'c', 's', timestamp '2024-01-03 10:00:00'")
    calendar = spark.sql("select 7L as cal_ord, 'x' as cal_title, 's' as cal_sport, timestamp '2024-01-01 12:00:00' as cal_start union all select 8L, 'x', 's', timestamp '2024-01-03 10:05:00'")
    got = reconcile.by_calendar(slots, calendar, spark.sql("select 'x' as cal_title, t as title, 'c' as tournament, 's' as sport from values ('a'), ('b') v(t)"))
    assert [tuple(r) for r in got.collect()] == [(1, "confirmed", 8, 5)]
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
