"""Checks of rows and batches, and the log of fetches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock, text

REQUIRED = ("source", "channel", "date", "time", "title")


def contract_errors(row_end: str = "slot_end") -> Column:
    """What is wrong with a row: missing fields, formats, an end that is not after the start."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in REQUIRED]
    empty = [F.when(F.btrim(c) == "", F.lit(f"empty:{c}")) for c in ("channel", "title")]
    formats = [
        F.when(F.col("date").isNotNull() & F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).isNull(), F.lit("format:date")),
        F.when(F.col("time").isNotNull() & ~F.col("time").rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), F.lit("format:time")),
        F.when(F.col(row_end) <= clock.parsed(F.col("date"), F.col("time")), F.lit("end:not_after_start")),
    ]
    return F.array_compact(F.array(*missing, *empty, *formats))


def findings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ord, level, finding: all that a check of a batch has to say, a row each.

    Errors are those of ``contract_errors``.  Of rows whose fields can be read, a direct broadcast without a sport or a title is
    warned of; and of each batch (ord is null) how many good rows repeat others.
    """
    errors = contract_errors()
    readable = ~F.exists("errors", lambda e: e.startswith("missing:") | e.startswith("format:"))
    blank = lambda c: F.btrim(F.coalesce(c, F.lit(""))) == ""
    direct = F.coalesce(F.col("is_live_broadcast"), F.lit(False)) & readable
    warnings = F.array_compact(F.array(F.when(direct & blank(F.col("sport")), F.lit("live_event_without_sport")), F.when(direct & blank(F.col("title")), F.lit("live_event_without_normalized_title"))))
    each = rows.withColumn("errors", errors)
    said = lambda found, level: each.select(*keys, "ord", F.lit(level).alias("level"), F.explode(found).alias("finding"))
    repeats = batch_check(rows, keys).where("repeats > 0").select(*keys, F.lit(None).cast("long").alias("ord"), F.lit("warning").alias("level"), F.concat(F.lit("duplicate_broadcasts="), "repeats").alias("finding"))
    return said(F.col("errors"), "error").unionByName(said(warnings, "warning")).unionByName(repeats)


def built(rows: DataFrame) -> DataFrame:
    """Rows of any adapter as one contract: fields without blanks at their ends, the title or the raw one for either, one flag for direct broadcasts, and what is wrong with the row.

    ``rows``: source, source_url, channel, date, time, sport, tournament, title, raw_title, is_live_broadcast, is_live, and, if
    they are there, timezone, end_method, end_confidence, slot_end.
    """
    have = set(rows.columns)
    own = lambda c: F.btrim(F.coalesce(c, F.lit("")))
    either = lambda a, b: own(F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b)))
    direct = F.coalesce("is_live_broadcast", "is_live", F.lit(False))
    plain = {c: own(F.col(c)) for c in ("source", "source_url", "channel", "date", "time", "sport", "tournament")}
    more = {"timezone": F.coalesce(F.nullif(own(F.col("timezone")), F.lit("")), F.lit(clock.L.ZONE)) if "timezone" in have else F.lit(clock.L.ZONE)}
    more["end_confidence"] = F.coalesce("end_confidence", F.lit("unknown")) if "end_confidence" in have else F.lit("unknown")
    more |= {c: F.lit(None).cast(t) for c, t in (("end_method", "string"), ("slot_end", "timestamp")) if c not in have}
    done = rows.withColumns(plain | {"title": either("title", "raw_title"), "raw_title": either("raw_title", "title"), "is_live_broadcast": direct, "is_live": direct} | more)
    return done.withColumn("errors", contract_errors())


def batch_check(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: rows, bad rows, errors by name, repeats among good rows, ok."""
    bad = contract_errors()
    r = rows.select(*keys, bad.alias("errors"), text.exact_key(F.col("date"), F.col("time"), F.col("channel"), F.col("title")).alias("key"))
    good = F.when(F.size("errors") == 0, F.col("key"))
    out = r.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.size("errors") > 0).alias("bad"), (F.count(good) - F.count_distinct(good)).alias("repeats"))
    return out.withColumn("ok", F.col("bad") == 0)


def latest_success(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The count of the last run that succeeded, per key."""
    return runs.where(F.col("status").isin("ok", "warning")).groupBy(*keys).agg(F.max(F.struct("seq", "event_count")).alias("r")).select(*keys, F.col("r.event_count").alias("previous"))


def latest_run(runs: DataFrame, newest: int = 100) -> DataFrame:
    """The last run of each source among the newest; the top is kept by task before it is merged."""
    top = runs.orderBy(F.col("seq").desc()).limit(newest)
    return top.groupBy("source").agg(F.max(F.struct("seq", "scope_date", "status", "event_count")).alias("r")).select("source", "r.*")


def before_each(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Each run with the count of the last successful run of its key before it."""
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("previous", F.last(F.when(F.col("status").isin("ok", "warning"), F.col("event_count")), ignorenulls=True).over(w))


def assessed(current: Column, previous: Column, failed: Column) -> Column:
    """status, reason of a count against the one before; the first rule that holds."""
    say = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))
    ratio = current / F.nullif(previous, F.lit(0))
    return (
        F.when(failed, say("error", "source_error"))
        .when(previous.isNull() & (current == 0), say("warning", "first_observation_is_empty"))
        .when(previous.isNull(), say("ok", "baseline_created"))
        .when((previous >= 3) & (current == 0), say("blocked", "event_count_collapsed_to_zero"))
        .when((previous >= 5) & (ratio <= 0.2), say("blocked", "event_count_drop_over_80_percent"))
        .when((previous >= 10) & (ratio <= 0.5), say("warning", "event_count_drop_over_50_percent"))
        .when((previous >= 5) & (current >= previous * 3), say("warning", "event_count_increased_over_3x"))
        .otherwise(say("ok", "source_output_looks_normal"))
    )


def rollup(assessments: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: degraded if any scope is blocked or failed, and the warnings in order."""
    return assessments.groupBy(*keys).agg(F.bool_or(F.col("verdict.status").isin("blocked", "error")).alias("degraded"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("verdict.status") != "ok", F.col("verdict.reason")))), ",").alias("reasons"))


def channel_health(channels: DataFrame, runs: DataFrame, rows: DataFrame) -> DataFrame:
    """Per channel of the dimension: its source's last run, and its rows in that run's scope."""
    last = latest_run(runs)  # one row a source, of the newest hundred runs: no more than those
    counts = rows.join(F.broadcast(last.select("source", F.col("scope_date").alias("date"))), ["source", "date"], "left_semi").groupBy("source", "channel").agg(F.count("*").alias("n"))
    return channels.join(last.select("source", "status", "scope_date"), "source", "left").join(counts, ["source", "channel"], "left").select("source", "channel", F.coalesce("status", F.lit("never")).alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


def incidents(assessments: DataFrame) -> DataFrame:
    """A row for each scope (source, scope_date, seq, verdict) that is blocked or failed: opened, and never resolved by itself."""
    bad = assessments.where(F.col("verdict.status").isin("blocked", "error"))
    return bad.select("source", "scope_date", "seq", F.col("verdict.status").alias("severity"), F.col("verdict.reason").alias("reason"), F.lit(None).cast("string").alias("resolved_at"))


def unresolved(found: DataFrame, n: int) -> DataFrame:
    """The n newest incidents that nobody has resolved."""
    return found.where("resolved_at is null").orderBy(F.col("seq").desc(), "source").limit(n)


def run_states(log: DataFrame) -> DataFrame:
    """run, status, started, finished: a run's rows of an append-only log (run, at, status, summary) as one; it runs until a row says otherwise."""
    last = log.groupBy("run").agg(F.max_by(F.struct("status", "summary"), F.struct("at", F.when(F.col("status") == "running", 0).otherwise(1))).alias("r"), F.min("at").alias("started"), F.max(F.when(F.col("status") != "running", F.col("at"))).alias("finished"))
    return last.select("run", "r.status", "r.summary", "started", "finished")


def latest_agent_run(log: DataFrame) -> DataFrame:
    return run_states(log).orderBy(F.col("started").desc(), F.col("run").desc()).limit(1)


def scope_outcome(failed: Column, required: Column, stored: Column) -> Column:
    """status, event_count of a scope: a required one that fails is an error; another falls back on what is stored with a warning that counts nothing, or is unavailable."""
    say = lambda s, n: F.struct(F.lit(s).alias("status"), n.cast("long").alias("event_count"), (F.lit(s) == "error").alias("incident"))
    none = F.lit(0)
    return F.when(~failed, say("ok", stored)).when(required, say("error", none)).when(stored > 0, say("warning", none)).otherwise(say("unavailable", none))


def toggled(subscriptions: DataFrame, changes: DataFrame) -> DataFrame:
    """reader: who is subscribed after the changes (reader, ord): each is a switch, so an even number of them changes nothing."""
    flips = changes.groupBy("reader").agg((F.count("*") % 2 == 1).alias("flip"))
    j = subscriptions.select("reader", F.lit(True).alias("was")).distinct().join(flips, "reader", "full")
    return j.where(F.coalesce("was", F.lit(False)) != F.coalesce("flip", F.lit(False))).select("reader")


def deliveries(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Every message to every reader of its source; ``subscriptions``: reader, source."""
    return messages.join(subscriptions, "source")
