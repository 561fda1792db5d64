"""The broadcast view ``bx`` of the event table, in both dialects, and tables made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The reference instant of the queries.
NOW = "2024-01-15 12:00:00"

_SPARK = """
with e as (select event_id, date_trunc('minute', ts) as st, user_id, event_type, cast(floor(value) as bigint) as v, cast(get_json_object(props,'$.k') as bigint) as k from {events}),
b as (select event_id as ord, case event_id % 3 when 0 then 'guide_a' when 1 then 'guide_b' else 'guide_c' end as source,
 'ch' || lpad(cast(user_id % 14 as string),2,'0') as channel, st as start_at,
 case event_type when 'view' then 'Футбол' when 'click' then 'Хоккей' when 'signup' then 'Теннис' when 'purchase' then 'Бокс' else '' end as sport,
 'Лига ' || cast(k % 4 as string) as tournament,
 'Команда ' || cast(k % 10 as string) || ' – Команда ' || cast(10 + k div 10 as string) as title,
 event_type <> 'error' as is_live_broadcast,
 case when event_id % 10 = 0 then null else st + make_dt_interval(0, 0, cast(30 + v % 180 as int), 0) end as slot_end from e),
u as (select * from b union all select ord + 1000000 as ord, 'guide_c' as source, channel, start_at, sport, tournament, upper(title) as title, is_live_broadcast, slot_end from b where ord % 50 = 7)
select ord, source, channel, date_format(start_at,'yyyy-MM-dd') as `date`, date_format(start_at,'HH:mm') as `time`, start_at, sport, tournament, title, is_live_broadcast, slot_end from u
"""

DUCK = """
bx_e as (select event_id, date_trunc('minute', ts) as st, user_id, event_type, cast(floor(value) as bigint) as v, cast(json_extract_string(props,'$.k') as bigint) as k from events),
bx_b as (select event_id as ord, case event_id % 3 when 0 then 'guide_a' when 1 then 'guide_b' else 'guide_c' end as source,
 'ch' || lpad(cast(user_id % 14 as varchar),2,'0') as channel, st as start_at,
 case event_type when 'view' then 'Футбол' when 'click' then 'Хоккей' when 'signup' then 'Теннис' when 'purchase' then 'Бокс' else '' end as sport,
 'Лига ' || cast(k % 4 as varchar) as tournament,
 'Команда ' || cast(k % 10 as varchar) || ' – Команда ' || cast(10 + k // 10 as varchar) as title,
 event_type <> 'error' as is_live_broadcast,
 case when event_id % 10 = 0 then null else st + to_minutes(cast(30 + v % 180 as integer)) end as slot_end from bx_e),
bx_u as (select * from bx_b union all select ord + 1000000 as ord, 'guide_c' as source, channel, start_at, sport, tournament, upper(title) as title, is_live_broadcast, slot_end from bx_b where ord % 50 = 7),
bx as (select ord, source, channel, strftime(start_at,'%Y-%m-%d') as "date", strftime(start_at,'%H:%M') as "time", start_at, sport, tournament, title, is_live_broadcast, slot_end from bx_u)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per broadcast; ``ord`` is the order in which guides listed them."""
    return spark.sql(_SPARK, events=table(spark, sf_dir, "events"))


def duck(body: str, *more: str) -> str:
    """DuckDB SQL over the view bx and further common tables."""
    return "with " + ",\n".join([DUCK.strip(), *more]) + "\n" + body


def recursive(body: str, *more: str) -> str:
    """``duck``, with common tables that read themselves."""
    return duck(body, *more).replace("with ", "with recursive ", 1)


def calendar(rows: DataFrame) -> DataFrame:
    """A calendar of real events: a part of the broadcasts, shifted by up to an hour."""
    kept = rows.where("ord % 3 = 0 and not (title like '%18' or title like '%19')")
    shift = F.expr("make_dt_interval(0, 0, cast((ord * 7) % 90 - 30 as int), 0)")
    return kept.select(F.col("ord").alias("cal_ord"), F.lower("title").alias("cal_title"), F.col("sport").alias("cal_sport"), (F.col("start_at") + shift).alias("cal_start"))


DUCK_CALENDAR = "cal as (select ord as cal_ord, lower(title) as cal_title, sport as cal_sport, start_at + to_minutes(cast((ord * 7) % 90 - 30 as integer)) as cal_start from bx where ord % 3 = 0 and not (title like '%18' or title like '%19'))"


def versions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of the same guide: rows come, go and move."""
    late = F.when(F.col("ord") % 13 == 0, F.col("start_at") + F.expr("interval 20 minutes")).otherwise(F.col("start_at"))
    return rows.where("ord % 7 <> 0"), rows.where("ord % 11 <> 0").withColumn("start_at", late)


DUCK_VERSIONS = """old as (select * from bx where ord % 7 <> 0),
new as (select * replace (case when ord % 13 = 0 then start_at + interval 20 minute else start_at end as start_at) from bx where ord % 11 <> 0)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of fetches: one row per event type and day, with a count that collapses on some days."""
    day = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("scope_date")).agg(F.count("*").alias("n"))
    of_month = F.substring("scope_date", 9, 2).cast("int")
    counted = day.withColumn("event_count", F.when(of_month % 9 == 0, 0).when(of_month % 7 == 0, F.expr("n div 6")).when(of_month % 5 == 0, F.expr("n * 4")).otherwise(F.col("n")))
    status = F.when(F.col("event_count") % 4 == 3, "error").when(F.col("event_count") % 4 == 2, "warning").otherwise("ok")
    code = F.crc32(F.col("source").cast("binary")) % 1000
    seq = F.date_diff(F.col("scope_date").cast("date"), F.lit("2024-01-01").cast("date")) * 1000 + code
    return counted.select("source", "scope_date", F.col("event_count").cast("long").alias("event_count"), status.alias("status"), seq.cast("long").alias("seq"))


DUCK_RUNS = """run_days as (select event_type as source, strftime(ts, '%Y-%m-%d') as scope_date, count(*) as n from events group by all),
run_counts as (select source, scope_date, case when cast(scope_date[9:10] as int) % 9 = 0 then 0 when cast(scope_date[9:10] as int) % 7 = 0 then n // 6 when cast(scope_date[9:10] as int) % 5 = 0 then n * 4 else n end as event_count from run_days),
runs as (select source, scope_date, cast(event_count as bigint) as event_count, case when event_count % 4 = 3 then 'error' when event_count % 4 = 2 then 'warning' else 'ok' end as status,
 cast(date_diff('day', date '2024-01-01', cast(scope_date as date)) * 1000 + case source when 'view' then {view} when 'click' then {click} when 'signup' then {signup} when 'purchase' then {purchase} when 'error' then {error} end as bigint) as seq from run_counts)"""


def _crc(name: str) -> int:
    import zlib

    return zlib.crc32(name.encode()) % 1000


DUCK_RUNS = DUCK_RUNS.format(**{x: _crc(x) for x in ("view", "click", "signup", "purchase", "error")})
