"""Television slots against a calendar of real events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import settled
from . import verify

EARLIEST, LATEST = -10, 45


def sport_compatible(a: Column, b: Column) -> Column:
    """Either is empty, the calendar's is 'other', or one is in the other."""
    a, b = text.norm_verify(a), text.norm_verify(b)
    return (a == "") | (b == "") | (b == "прочее") | a.contains(b) | b.contains(a)


def minutes_between(a: Column, b: Column) -> Column:
    """Whole minutes from a to b, towards zero."""
    return ((F.unix_timestamp(b) - F.unix_timestamp(a)) / 60).cast("long")


#: An event's text, by which calendar rows are looked up.
EVENT = ("title", "tournament", "sport")
#: Characters of an equi-join key.
GRAM = 5


def mentions(events: DataFrame, calendar_titles: DataFrame, gram: int = GRAM) -> DataFrame:
    """The columns of ``events`` and cal_title: calendar texts that are about an event, by ``verify.told``.

    Both inputs have one row per distinct text (``events``: title and, if there are, tournament and sport).
    A text about an event contains a word or name of each of some sets: an alias of either side, the tournament
    or any one of its words, or one of its telling words even without the commonest, as two must be there.  Of an event's sets
    the one that is found least often in the calendar, by counted runs of letters, is looked for; the last
    characters of its members are an equi-join key on the runs of as many characters of the
    texts, which misses nothing, and the whole predicate is tested on what is left.
    """
    given = [c for c in EVENT if c in events.columns]
    for c in EVENT:
        if c not in given:
            events = events.withColumn(c, F.lit(""))
    known = settled(events.select(*EVENT, verify.facts(*map(F.col, EVENT)).alias("of")).withColumn("event", F.monotonically_increasing_id()), "events")
    named = F.filter(F.array(text.norm_verify(F.col("tournament")), text.norm_verify(text.englished(F.col("tournament")))), lambda x: x != "")
    tokens, words = text.significant_tokens(F.col("tournament")), F.col("of.words")
    draw = F.when(F.size(tokens) > 0, F.transform(tokens, lambda t: F.concat(named, F.array(t)))).otherwise(F.array(named))
    some = F.when(F.size(words) > 1, F.transform(words, lambda w: F.array_remove(words, w))).otherwise(F.array(words))
    sets = F.when(F.col("of.kind") == "MATCH", F.col("of.sides")).when(F.col("of.kind") == "DRAW", draw).otherwise(some)
    want = settled(known.select("event", F.posexplode(sets).alias("choice", "any_of")).select("event", "choice", F.explode(F.array_distinct(F.transform("any_of", lambda x: F.right(x, F.lit(gram))))).alias("gram")), "grams")
    texts = calendar_titles.select("cal_title", text.norm_verify(F.col("cal_title")).alias("said")).where("said <> ''")
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.length("said")), lambda i: F.substr("said", i, F.lit(n)))
    asked = want.select("gram").distinct()
    have = settled(texts.withColumn("gram", F.explode(F.array_distinct(F.concat(*map(runs, range(1, gram + 1)))))).join(asked, "gram", "left_semi"), "runs")
    often = have.groupBy("gram").agg(F.count("*").alias("n"))
    cost = want.join(often, "gram", "left").groupBy("event", "choice").agg(F.sum(F.coalesce("n", F.lit(0))).alias("cost"))
    rarest = cost.groupBy("event").agg(F.min(F.struct("cost", "choice")).alias("b")).select("event", F.col("b.choice").alias("choice"))
    pairs = want.join(rarest, ["event", "choice"]).join(have, "gram").select("event", "cal_title", "said").distinct()
    return pairs.join(known, "event").where(verify.told(F.col("said"), F.col("of"))).select(*given, "cal_title").distinct()


def by_calendar(slots: DataFrame, calendar: DataFrame, matched: DataFrame, exact: bool = False) -> DataFrame:
    """One row per slot: ord, state (confirmed, mismatch or unknown), cal_ord, difference (minutes).

    ``slots``: ord, title, tournament, sport, start_at; ``calendar``: cal_ord, cal_title, cal_sport, cal_start;
    ``matched``: cal_title and those of title, tournament and sport that tell an event.  Starts are whole minutes.  A plausible event wins over others, then
    the nearest, then the first in the calendar; a far one makes a mismatch, however far.  ``exact``:
    only the very minute is plausible.

    Only the nearest event before and after a slot can win, so this is an as-of search: slots and events
    of a title and sport are sorted together by day, and each day gets the last event of earlier days
    and the first of later ones, so that no task sorts more than a day of one title.
    """
    texts = [c for c in EVENT if c in matched.columns or c == "sport"]
    minute = lambda c: F.floor(F.unix_timestamp(c) / 60)
    day = F.floor(F.col("m") / 1440)
    # a number for each different text of slots: rows by the minute carry that, and whether sports go together is judged once for each pair of texts
    known = settled(slots.select(*texts).distinct().withColumn("k", F.monotonically_increasing_id()), "keys")
    once = settled(calendar.groupBy("cal_title", "cal_sport", minute("cal_start").alias("m")).agg(F.min("cal_ord").alias("cal_ord")), "once")
    about = once.select("cal_title", "cal_sport").distinct().join(matched, "cal_title").join(known, [c for c in texts if c in matched.columns]).where(sport_compatible(F.col("sport"), F.col("cal_sport"))).select("k", "cal_title", "cal_sport")
    # null sports or titles of the calendar go with what they went with in ``about``
    same = F.expr("o.cal_title <=> a.cal_title and o.cal_sport <=> a.cal_sport")
    events = once.alias("o").join(settled(about, "about").alias("a"), same).groupBy("k", "m").agg(F.min("cal_ord").alias("cal_ord")).withColumn("day", day)
    own = known.withColumnsRenamed({c: f"_{c}" for c in texts})
    asked = slots.join(own, F.expr(" and ".join(f"{c} <=> _{c}" for c in texts))).select("ord", "k", minute("start_at").alias("m")).withColumn("day", day)
    key = ["k"]

    ends = events.groupBy(*key, "day").agg(F.min(F.struct("m", "cal_ord")).alias("first"), F.max(F.struct("m", "cal_ord")).alias("last"))
    days = asked.select(*key, "day").distinct().join(ends, [*key, "day"], "full")
    # a frame that ends at the last row is gone through anew for each row: what follows is looked for backwards
    w, back_w = (Window.partitionBy(*key).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("day", F.desc("day")))
    carried = days.withColumns({"before": F.last("last", ignorenulls=True).over(w), "after": F.last("first", ignorenulls=True).over(back_w)})
    event = F.struct("m", "cal_ord")
    none = F.lit(None).cast("struct<m:long,cal_ord:long>")
    rows = asked.select(*key, "day", "m", "ord", none.alias("e")).unionByName(events.select(*key, "day", "m", F.lit(None).cast("long").alias("ord"), event.cast("struct<m:long,cal_ord:long>").alias("e")))
    back = Window.partitionBy(*key, "day").orderBy("m").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*key, "day").orderBy(F.desc("m")).rangeBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumns({"b": F.last("e", ignorenulls=True).over(back), "a": F.last("e", ignorenulls=True).over(ahead)}).where("ord is not null")
    seen = seen.join(carried.select(*key, "day", "before", "after"), [*key, "day"], "left")

    def candidate(e: Column) -> Column:
        d = e["m"] - F.col("m")
        far = (d != 0) if exact else ~d.between(EARLIEST, LATEST)
        return F.when(e.isNotNull(), F.struct(far.alias("far"), F.abs(d).alias("minutes"), e["cal_ord"].alias("cal_ord"), d.alias("difference")))

    best = F.array_min(F.array_compact(F.array(*(candidate(F.coalesce(F.col(x), F.col(y))) for x, y in (("b", "before"), ("a", "after"))))))
    state = F.when(F.col("best").isNull(), "unknown").when(F.col("best.far"), "mismatch").otherwise("confirmed")
    return seen.groupBy("ord").agg(F.min(best).alias("best")).select("ord", state.alias("state"), F.col("best.cal_ord").alias("cal_ord"), F.col("best.difference").alias("difference"))


def outcome(rows: DataFrame) -> DataFrame:
    """A slot's flags by its state: confirmed is direct and a sport event; all else is not, and unknown stays unknown."""
    confirmed = F.col("state") == "confirmed"
    return rows.withColumns({"is_live_broadcast": confirmed, "is_sport_event": confirmed, "live_state": F.when(confirmed, "live").when(F.col("state") == "mismatch", "not_live").otherwise("unknown")})


def third_party(slots: DataFrame, rows: DataFrame) -> DataFrame:
    """ord, third_ord, badge_state: the first third-party row of the day and channel that is about the event; null where none is.

    ``rows``: third_ord, date, channel, third_text.
    """
    titles = mentions(slots.select(*EVENT).distinct(), rows.select(F.col("third_text").alias("cal_title")).distinct()).withColumnRenamed("cal_title", "third_text")
    named = slots.select("ord", "date", "channel", *EVENT).join(titles, list(EVENT)).join(rows, ["date", "channel", "third_text"])
    first = named.groupBy("ord").agg(F.min("third_ord").alias("third_ord"))
    return slots.select("ord").join(first, "ord", "left").withColumn("badge_state", F.when(F.col("third_ord").isNotNull(), "third_party_live_unconfirmed").otherwise("unknown"))


def within_budget(rows: DataFrame, now: str, n: int = 20, back_hours: int = 6, ahead_hours: int = 36) -> DataFrame:
    """Slots near the instant that go to the slow check: the first n; the rest are pending."""
    at = F.lit(now).cast("timestamp")
    near = rows.where(F.col("start_at").between(at - F.expr(f"interval {back_hours} hours"), at + F.expr(f"interval {ahead_hours} hours")))
    first = near.orderBy("date", "time", "channel", "ord").limit(n).select("ord", F.lit(True).alias("chosen"))
    return near.join(F.broadcast(first), "ord", "left").withColumn("turn", F.when(F.col("chosen"), "checked").otherwise("pending")).drop("chosen")


#: Minutes for which a stored verdict is used again, by its state; all others for the last.
KEPT_MINUTES = {"confirmed": 720, "mismatch": 720, "unknown": 30}
KEPT_OTHERS = 5


def verdict_key(channel: Column, date: Column, time: Column, title: Column) -> Column:
    """By what a stored verdict is found again."""
    return F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in (channel, date, time)), F.lower(text.collapsed(title)))


def still_valid(state: Column, checked_at: Column, now: str) -> Column:
    minutes = F.coalesce(*(F.when(state == k, F.lit(v)) for k, v in KEPT_MINUTES.items()), F.lit(KEPT_OTHERS))
    return minutes_between(checked_at, F.lit(now).cast("timestamp")) < minutes


def driven(rows: DataFrame, near: DataFrame, exact: DataFrame, stored: DataFrame, strict: tuple[str, ...], now: str, n: int = 20) -> DataFrame:
    """ord, turn, state of every sport event's reconciliation.

    ``rows``: ord, channel, date, time, title, start_at, is_sport_event; ``near`` and ``exact``: ord, state by the calendar, of which
    channels in ``strict`` want the very minute; ``stored``: key, state, checked_at of earlier slow checks.

    What the calendar knows holds (turn: calendar).  A strict channel's event that it does not know waits for it (strict).  For others a
    stored verdict that is still valid is used again (cached); of the rest, those near the instant go to the slow check, the first ``n`` of
    them now (checked), and all others wait (pending).  Only what is checked now has no state yet.
    """
    asked = rows.where("is_sport_event").withColumns({"is_strict": F.col("channel").isin(*strict), "key": verdict_key(*map(F.col, ("channel", "date", "time", "title")))})
    by = lambda df, name: df.select("ord", F.col("state").alias(name))
    told = asked.join(by(near, "near"), "ord", "left").join(by(exact, "exact"), "ord", "left").withColumn("state", F.coalesce(F.when(F.col("is_strict"), F.col("exact")).otherwise(F.col("near")), F.lit("unknown")))
    last = stored.groupBy("key").agg(F.max(F.struct("checked_at", "state")).alias("v")).select("key", F.col("v.state").alias("kept"), F.col("v.checked_at").alias("checked_at"))
    j = told.join(last.where(still_valid(F.col("kept"), F.col("checked_at"), now)), "key", "left")
    known = F.col("state").isin("confirmed", "mismatch")
    first = settled(j.withColumn("turn", F.when(known, "calendar").when(F.col("is_strict"), "strict").when(F.col("kept").isNotNull(), "cached")), "turns")
    slow = within_budget(first.where("turn is null").select("ord", "date", "time", "channel", "start_at"), now, n).select("ord", F.col("turn").alias("slow"))
    out = first.join(slow, "ord", "left").withColumn("turn", F.coalesce("turn", "slow", F.lit("pending")))
    return out.select("ord", "turn", F.when(F.col("turn") == "cached", F.col("kept")).when(F.col("turn") != "checked", F.col("state")).alias("state"))
