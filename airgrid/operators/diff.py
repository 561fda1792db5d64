"""Differences between two snapshots of a schedule."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled
from . import ordered

END_MINUTES = 15


def nearest_left(olds: list[tuple[int, int]], news: list[tuple[int, int]]) -> list[tuple[int | None, int | None]]:
    """Pairs of (start, ord) rows, both sorted: each old one in turn takes the nearest new one left, the earlier of two equally near, the first of equal ones; then those left over.

    Places that are taken point on to the next that are not, so a search takes no longer the more are taken.
    """
    starts = [s for s, _ in news]
    after, before = list(range(len(news) + 1)), list(range(-1, len(news)))  # before[i]: the place of a free one below i

    def free(at: list[int], i: int, shift: int) -> int:
        while at[i] != i - shift:
            j = at[i] + shift
            at[i] = at[j]
            i = j
        return i - shift

    out = []
    for start, ord_ in olds:
        i = bisect_left(starts, start)
        up, down = free(after, i, 0), free(before, i, 1)
        if up == len(news) and down < 0:
            out.append((ord_, None))
            continue
        take = up
        if down >= 0 and (up == len(news) or start - starts[down] <= starts[up] - start):
            take = free(after, bisect_left(starts, starts[down]), 0)
        out.append((ord_, news[take][1]))
        after[take], before[take + 1] = take + 1, take - 1
    return out + [(None, news[i][1]) for i in range(len(news)) if after[i] == i]


class _Run:
    """Rows of one identity that may still contend for each other."""

    def __init__(self, key: str):
        self.key, self.sides = key, ([], [])
        self.first = self.last = None

    def take(self, start: int, ord_: int, side: int):
        """One more row; first the pairs of those before it, if it cannot contend with them."""
        olds, news = self.sides
        if self.first is not None and len(olds) == len(news) and start > self.last and start - self.last >= self.last - self.first:
            yield from self.pairs()
        if self.first is None:
            self.first = start
        self.last = start
        self.sides[side].append((start, ord_))

    def pairs(self):
        for a, b in nearest_left(*self.sides):
            yield self.key, a, b
        self.sides, self.first = ([], []), None


def paired(old: DataFrame, new: DataFrame, key: str = "identity") -> DataFrame:
    """Full outer: old_ord, new_ord of events with one identity.

    ``old`` and ``new``: identity, ord, start (a number).  Old events, by start, each take the nearest new
    one left (greedy, ties to the earlier).  An identity's rows are walked in order of start and cut
    into runs that cannot contend for one partner: as many old as new ones, and no further apart than the
    next row is away.  Each finds its partner within, whatever comes after; so only a run is held, and
    an event that is told every day is a run a day.
    """
    side = lambda df, n: df.select(key, "ord", "start", F.lit(n).alias("side"))
    single = lambda df, n: df.groupBy(key).agg(F.count("*").alias(f"n_{n}"), F.first("ord").alias(f"{n}_ord"))
    # identities with one row on either side, by far the most, are a plain join of counts
    sizes = settled(single(old, "old").join(single(new, "new"), key, "full"), "identities")
    lone = (F.coalesce("n_old", F.lit(0)) <= 1) & (F.coalesce("n_new", F.lit(0)) <= 1)
    both = side(old, 0).unionByName(side(new, 1)).join(sizes.where(~lone).select(key), key, "left_semi")

    kind = new.schema["ord"].dataType.simpleString()
    fields = f"{key} {new.schema[key].dataType.simpleString()}, old_ord {kind}, new_ord {kind}"
    walked = ordered.walked(both, [key], ["start", "ord", "side"], ["start", "ord", "side"], fields, _Run, _Run.take, _Run.pairs)
    return sizes.where(lone).select(key, "old_ord", "new_ord").unionByName(walked)


def still_relevant(ends: Column, now: str) -> Column:
    """Any broadcast ends after the instant."""
    return F.coalesce(ends > F.lit(now).cast("timestamp"), F.lit(False))


def changes(old: DataFrame, new: DataFrame, pairs: DataFrame, now: str) -> DataFrame:
    """identity, old_ord, new_ord, change (added, removed, updated, same), start_moved, end_moved, channel_moved.

    ``old`` and ``new``: ord, channel, start, end.  Removed events that are over are left out;
    an end counts as moved from END_MINUTES on.
    """
    side = lambda df, p: df.select(F.col("ord").alias(f"{p}_ord"), *(F.col(c).alias(f"{p}_{c}") for c in ("channel", "start", "end")))
    j = pairs.join(side(old, "old"), "old_ord", "left").join(side(new, "new"), "new_ord", "left")
    start = ~F.col("old_start").eqNullSafe(F.col("new_start"))
    end = F.coalesce(F.abs(F.unix_timestamp("old_end") - F.unix_timestamp("new_end")) >= END_MINUTES * 60, F.lit(False))
    channel = ~F.col("old_channel").eqNullSafe(F.col("new_channel"))
    kind = F.when(F.col("old_ord").isNull(), "added").when(F.col("new_ord").isNull(), "removed").when(start | end | channel, "updated").otherwise("same")
    both = F.col("old_ord").isNotNull() & F.col("new_ord").isNotNull()
    flag = lambda c: (both & c)
    out = j.withColumns({"change": kind, "start_moved": flag(start), "end_moved": flag(end), "channel_moved": flag(channel)})
    return out.where((F.col("change") != "removed") | still_relevant(F.coalesce("old_end", F.col("old_start") + F.expr("interval 2 hours")), now))


def channel_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per identity and channel: field (time, end, channel added or removed) with old and new.

    ``old`` and ``new``: identity, channel, start, end, one row for each identity and channel.
    """
    j = old.select("identity", "channel", F.col("start").alias("os"), F.col("end").alias("oe"), F.lit(True).alias("was")).join(new.select("identity", "channel", F.col("start").alias("ns"), F.col("end").alias("ne"), F.lit(True).alias("is")), ["identity", "channel"], "full")
    one = lambda field, a, b: F.struct(F.lit(field).alias("field"), a.cast("string").alias("old"), b.cast("string").alias("new"))
    both = F.col("was").isNotNull() & F.col("is").isNotNull()
    end = F.coalesce(F.abs(F.unix_timestamp("oe") - F.unix_timestamp("ne")) >= END_MINUTES * 60, F.lit(False))
    found = F.array_compact(F.array(
        F.when(F.col("was").isNull(), one("channel_added", F.lit(None), F.col("channel"))),
        F.when(F.col("is").isNull(), one("channel_removed", F.col("channel"), F.lit(None))),
        F.when(both & (F.col("os") != F.col("ns")), one("time", F.date_format("os", "yyyy-MM-dd HH:mm"), F.date_format("ns", "yyyy-MM-dd HH:mm"))),
        F.when(both & end, one("end", F.date_format("oe", "yyyy-MM-dd HH:mm"), F.date_format("ne", "yyyy-MM-dd HH:mm"))),
    ))
    return j.select("identity", "channel", F.explode(found).alias("c")).select("identity", "channel", "c.*")


#: What a change is told of where an event has left all its channels for others.
AIR = "Эфир"


def channel_updates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes of events on both sides: identity, channel, field (channels, time, end), old, new.

    ``old`` and ``new``: identity, channel, start, end, one row for each identity and channel.  A changed set of channels is one
    change with both sets; starts and ends are compared channel by channel, or, where no channel is
    common, between the earliest broadcasts of either side.
    """
    name = lambda p, df: df.select("identity", "channel", F.struct("start", F.col("channel").alias("on"), "end").alias(p))
    j = name("o", old).join(name("n", new), ["identity", "channel"], "full")
    channels = lambda p: F.array_sort(F.collect_set(F.when(F.col(p).isNotNull(), F.col("channel")))).alias(f"{p}_set")
    events = j.groupBy("identity").agg(channels("o"), channels("n"), F.min("o").alias("o"), F.min("n").alias("n")).where((F.size("o_set") > 0) & (F.size("n_set") > 0))
    change = lambda field, channel, a, b: F.struct(F.lit(field).alias("field"), channel.alias("channel"), a.alias("old"), b.alias("new"))
    said = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm")
    far = F.coalesce(F.abs(F.unix_timestamp("o.end") - F.unix_timestamp("n.end")) >= END_MINUTES * 60, F.lit(False))

    def moved(channel: Column) -> Column:
        return F.array_compact(F.array(F.when(F.col("o.start") != F.col("n.start"), change("time", channel, said("o.start"), said("n.start"))), F.when(far, change("end", channel, said("o.end"), said("n.end")))))

    sets = F.array_compact(F.array(F.when(F.col("o_set") != F.col("n_set"), change("channels", F.lit(""), F.array_join("o_set", ","), F.array_join("n_set", ",")))))
    apart = F.when(~F.arrays_overlap("o_set", "n_set"), moved(F.lit(AIR))).otherwise(F.array().cast("array<struct<field:string,channel:string,old:string,new:string>>"))
    of_event = events.select("identity", F.explode(F.concat(sets, apart)).alias("c"))
    of_channel = j.where(F.col("o").isNotNull() & F.col("n").isNotNull()).select("identity", F.explode(moved(F.col("channel"))).alias("c"))
    return of_event.unionByName(of_channel).select("identity", "c.channel", "c.field", "c.old", "c.new")


def systemic_shift(moves: DataFrame, least: int = 3) -> DataFrame:
    """One row: whether a batch of updates is a guide's slip of one whole day and not news.

    ``moves``: identity, channel, minutes of each start moved.  At least ``least`` events, one
    channel, one shift, of a day.
    """
    agg = moves.agg(F.count("*").alias("n"), F.count_distinct("channel").alias("channels"), F.count_distinct("minutes").alias("shifts"), F.min("minutes").alias("minutes"), F.count_distinct("identity").alias("events"))
    return agg.select("n", "events", ((F.col("events") >= least) & (F.col("n") == F.col("events")) & (F.col("channels") == 1) & (F.col("shifts") == 1) & (F.abs("minutes") == 1440)).alias("systemic"))


def systemic_changes(changes: DataFrame, least: int = 3) -> DataFrame:
    """``systemic_shift`` over a whole diff (identity, channel, field, minutes): nothing but moved starts, one for each event, and ends moved as much."""
    starts = F.col("field") == "time"
    agg = changes.agg(F.count_if(starts).alias("n"), F.count_distinct("identity").alias("events"), F.count_distinct("channel").alias("channels"), F.count_distinct("minutes").alias("shifts"), F.min("minutes").alias("minutes"), F.bool_and(F.col("field").isin("time", "end")).alias("moves"))
    sure = F.col("moves") & (F.col("events") >= least) & (F.col("n") == F.col("events")) & (F.col("channels") == 1) & (F.col("shifts") == 1) & (F.abs("minutes") == 1440)
    return agg.select("n", "events", F.coalesce(sure, F.lit(False)).alias("systemic"))
