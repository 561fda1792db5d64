"""The same event on several channels, and snapshots of events."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import ordered
from .reconcile import minutes_between
from .texts import made_once

MINUTES = 30


def _wild(a: Column, b: Column) -> Column:
    return (a == "") | (b == "") | (a == b)


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with norm_title, norm_sport, norm_tournament, made once for each different event."""
    event = ["title", "sport", "tournament"]
    return made_once(rows, event, {f"norm_{c}": text.norm_match(F.col(c)) for c in event})


def pairs(rows: DataFrame, minutes: int = MINUTES) -> DataFrame:
    """a, b (a < b): broadcasts of one event on two channels.

    Joined on title and on a half-hour slot of the start: the later side looks in its own slot
    and the one before, so a title that is always on does not pair with itself all year.
    """
    slot = F.floor(F.unix_timestamp("start_at") / (minutes * 60))
    r = keyed(rows).where("norm_title <> ''").select("ord", "channel", "start_at", "norm_title", "norm_sport", "norm_tournament", slot.alias("slot"))
    left = r.select(*(F.col(c).alias(f"l_{c}") for c in r.columns)).withColumn("slot", F.explode(F.array(F.col("l_slot"), F.col("l_slot") + 1))).withColumnRenamed("l_norm_title", "norm_title")
    same = _wild(F.col("l_norm_sport"), F.col("norm_sport")) & _wild(F.col("l_norm_tournament"), F.col("norm_tournament"))
    near = (F.col("l_start_at") < F.col("start_at")) | ((F.col("l_start_at") == F.col("start_at")) & (F.col("l_ord") < F.col("ord")))
    both = left.join(r, ["norm_title", "slot"]).where((F.col("l_channel") != F.col("channel")) & same & near & (minutes_between(F.col("l_start_at"), F.col("start_at")) <= minutes))
    return both.select(F.least("l_ord", "ord").alias("a"), F.greatest("l_ord", "ord").alias("b"))


class _Heard:
    """How many broadcasts of each sport and tournament each channel has, also by either alone (the other None) and in all."""

    def __init__(self) -> None:
        self.n: dict[tuple, dict] = {}
        self.size = 0

    def add(self, channel: str, sport: str, tournament: str, by: int) -> None:
        self.size += by
        for kind in ((sport, tournament), (None, tournament), (sport, None), (None, None)):
            seen = self.n.setdefault(kind, {})
            seen[channel] = seen.get(channel, 0) + by
            if not seen[channel]:
                del seen[channel]
                if not seen:
                    del self.n[kind]

    def fits(self, channel: str, sport: str, tournament: str) -> bool:
        """Whether another channel has a broadcast that goes with these; an empty sport or tournament goes with all."""
        for s in (sport, "") if sport else (None,):
            for t in (tournament, "") if tournament else (None,):
                seen = self.n.get((s, t))
                if seen and (len(seen) > 1 or channel not in seen):
                    return True
        return False


class _Walk:
    """A title's broadcasts of the last minutes, and the groups that have any of them, in the order in which they were made."""

    def __init__(self, *key) -> None:
        self.recent: list[tuple] = []
        self.groups: dict[int, tuple[int, _Heard]] = {}
        self.all = _Heard()
        self.made = self.taken = 0

    def forget(self, t: int, minutes: int) -> None:
        while self.recent and (t - self.recent[0][0]) // 60 > minutes:
            _, _, g, *of = heapq.heappop(self.recent)
            self.all.add(*of, -1)
            self.groups[g][1].add(*of, -1)
            if not self.groups[g][1].size:
                del self.groups[g]

    def join(self, name: int, t: int, *of) -> int:
        """The name of the first group that has a broadcast of the same event on another channel, or of a new one."""
        g = next((g for g, (_, heard) in self.groups.items() if heard.fits(*of)), None) if self.all.fits(*of) else None
        if g is None:
            self.made = g = self.made + 1
            self.groups[g] = (name, _Heard())
        self.taken += 1
        heapq.heappush(self.recent, (t, self.taken, g, *of))
        self.all.add(*of, 1)
        self.groups[g][1].add(*of, 1)
        return self.groups[g][0]


def groups(rows: DataFrame, minutes: int = MINUTES) -> DataFrame:
    """ord, group_ord: each row, in order, joins the first group with a broadcast of the same event; groups never merge.

    Rows of one group have equal titles and follow each other within ``minutes``; where a title
    is silent for longer, no group goes across.  So titles are first cut at such gaps, and each
    piece is walked on its own: a title on the air all year is many small pieces.  Only groups and
    broadcasts of the last ``minutes`` are kept, counted by channel, sport and tournament, so that a row's time does
    not grow with how many there are.  A title that is never silent is one task's, as each of its groups depends on those before.
    """
    k = keyed(rows).select("ord", "channel", "date", "time", F.unix_timestamp("start_at").alias("at"), "norm_title", "norm_sport", "norm_tournament")
    alone = k.where("norm_title = ''").select("ord", F.col("ord").alias("group_ord"))
    pieces = ordered.runs(k.where("norm_title <> ''"), "norm_title", "at", "ord", minutes * 60 + 59, "piece")

    def fit(walk: _Walk, ord_: int, channel: str, t: int, sport: str, tournament: str):
        walk.forget(t, minutes)
        yield ord_, walk.join(ord_, t, channel, sport, tournament)

    columns = ["ord", "channel", "at", "norm_sport", "norm_tournament"]
    found = ordered.walked(pieces, ["norm_title", "piece"], ["date", "time", "channel", "ord"], columns, "ord long, group_ord long", _Walk, fit)
    return found.unionByName(alone)


def snapshot(rows: DataFrame, minutes: int = MINUTES) -> DataFrame:
    """One row per group: identity and attributes of its first broadcast, and broadcasts (channel, start, end) by start and channel."""
    order = F.struct("date", "time", "channel", "ord")
    joined = rows.join(groups(rows, minutes), "ord")
    first = lambda c: F.min_by(c, order).alias(c)
    made = joined.groupBy("group_ord").agg(
        first("sport"), first("tournament"), first("title"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("start_at").alias("start"), "channel", F.col("slot_end").alias("end")))), lambda b: F.struct(b["channel"].alias("channel"), b["start"].alias("start"), b["end"].alias("end"))).alias("broadcasts"),
    )
    return made.withColumn("identity", text.identity(F.col("sport"), F.col("tournament"), F.col("title")))
