"""The schedule that users see: merged, filtered, sorted, counted, exported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock, evidence, text
from . import ordered


def first_by(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key in the order given.

    An aggregate of structs, not a window: each task keeps one row a key before the shuffle,
    so a key with very many rows costs no more than others.
    """
    rest = [c for c in df.columns if c not in order]
    least = F.min(F.struct(*order, *rest)).alias("r")
    return df.groupBy(*(k.alias(f"_k{i}") for i, k in enumerate(keys))).agg(least).select(*(F.col(f"r.`{c}`").alias(c) for c in df.columns))


def dedup(rows: DataFrame) -> DataFrame:
    """One row per date, time, channel and title, the first listed; the source does not tell rows apart."""
    return first_by(rows, [F.col("date"), F.col("time"), text.norm_match(F.col("channel")), text.norm_match(F.col("title"))], ["ord"])


def in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("date", "time", "channel", "ord")


def merged(*sources: DataFrame) -> DataFrame:
    """All guides as one, without repeats, in order."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return in_order(dedup(out))


def with_status(rows: DataFrame, now: str) -> DataFrame:
    b = clock.bounds(F.col("start_at"), F.col("slot_end"), F.col("sport"))
    return rows.withColumn("b", b).withColumns({"end_at": F.col("b.end"), "end_method": F.col("b.method"), "status": clock.status(F.col("b.start"), F.col("b.end"), now)}).drop("b")


def editorial() -> Column:
    return evidence.is_editorial(F.col("title"), F.col("tournament"), F.col("sport"))


def direct() -> Column:
    return evidence.is_direct(editorial(), F.col("is_live_broadcast"), F.lit(None).cast("boolean"))


def first_failed(now: str, day: str | None = None) -> Column:
    """Why a row is not shown: the first reason that holds, null for rows that are shown.  Needs status."""
    words = evidence.event_text(F.col("title"), F.col("tournament"), F.col("sport"))
    candidate = evidence.is_candidate(editorial(), F.lit(None).cast("boolean"), direct(), F.col("sport"), F.col("tournament"), words)
    user = evidence.is_user_event(F.col("title"), F.col("sport"), F.col("tournament"))
    out = F.when(~direct(), "not_confirmed_direct").when(~candidate, "not_sport_candidate").when(~user, "non_sport_studio")
    if day is None:
        out = out.when((F.col("date") < now[:10]) & (F.col("status") != "live"), "past_not_on_air")
    return out


def skipped(now: str) -> Column:
    """Why a refreshed row is not kept: the first reason that holds, null for rows that are.  By the old flag alone, before anything is judged; needs status."""
    user = evidence.is_user_event(F.col("title"), F.col("sport"), F.col("tournament"))
    return F.when(~F.coalesce("is_live", F.lit(False)), "not_direct").when(~user, "non_sport_studio").when((F.col("date") < now[:10]) & (F.col("status") != "live"), "past_not_live")


def visible(rows: DataFrame, now: str, day: str | None = None) -> DataFrame:
    """What a user sees: of one day, or from today on, where past days have only what is still on the air."""
    if day is not None:
        rows = rows.where(F.col("date") == day)  # prunes partitions by date
    return with_status(dedup(rows), now).where(first_failed(now, day).isNull())


def upcoming(rows: DataFrame, now: str, k: int) -> DataFrame:
    return in_order(visible(rows, now).where(F.col("status") == "upcoming")).limit(max(0, k))


def bounded_view(rows: DataFrame, n: int | None) -> DataFrame:
    """The first n rows with the number of all."""
    total = rows.agg(F.count("*").alias("total"))
    return (in_order(rows).limit(n) if n is not None else in_order(rows)).crossJoin(F.broadcast(total))


MODES = {"all": ("live", "upcoming", "finished"), "live": ("live",), "finished_upcoming": ("finished", "upcoming")}


def export_rows(rows: DataFrame, mode: str = "all") -> DataFrame:
    """The columns of an export, by mode."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {sorted(MODES)}")
    return rows.where(F.col("status").isin(*MODES[mode])).select(
        F.col("ord"),
        F.date_format("start_at", "dd.MM.yyyy").alias("start_date"),
        F.date_format("start_at", "HH:mm").alias("start_time"),
        F.date_format("end_at", "dd.MM.yyyy").alias("end_date"),
        F.date_format("end_at", "HH:mm").alias("end_time"),
        F.upper("status").alias("status"),
        "channel", "sport", "tournament", "title", "source",
        F.when(direct(), "Yes").otherwise("No").alias("direct"),
        clock.window_text(F.col("start_at"), F.col("end_at")).alias("window"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """Counts of all, of each channel and of each source in one pass of grouping sets."""
    named = rows.select(F.coalesce(F.nullif("channel", F.lit("")), F.lit("—")).alias("channel"), F.coalesce(F.nullif("source", F.lit("")), F.lit("—")).alias("source"), "status", direct().alias("direct"))
    level = F.when(F.grouping("channel") == 0, "channel").when(F.grouping("source") == 0, "source").otherwise("all")
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    sets = named.groupingSets([[F.col("channel")], [F.col("source")], []], "channel", "source")
    return sets.agg(level.alias("level"), F.count("*").alias("total"), count("live"), count("upcoming"), count("finished"), F.count_if("direct").alias("direct")).select("level", F.coalesce("channel", "source", F.lit("")).alias("name"), "total", "live", "upcoming", "finished", "direct")


def horizon(rows: DataFrame, today: str) -> DataFrame:
    """All days from today to the last that has rows."""
    return rows.agg(F.max("date").alias("last")).select(F.explode(F.sequence(F.lit(today).cast("date"), F.greatest(F.col("last").cast("date"), F.lit(today).cast("date")))).alias("day"))


def scopes(sources: DataFrame, today: str) -> DataFrame:
    """source, scope_date for each source (source, lookahead): yesterday to its lookahead."""
    return sources.select("source", F.explode(F.transform(F.sequence(F.lit(-1), F.col("lookahead")), lambda k: F.date_add(F.lit(today).cast("date"), k))).alias("scope_date"))


def packed(lines: DataFrame, keys: list[str], limit: int = 3900, gap: int = 2) -> DataFrame:
    """Texts joined into messages in order: keys, message (from 0), body.

    ``lines`` has keys, ord, text.  A text goes into the open message if it fits, and opens the next if not;
    a longer one is a message by itself.  Only the open message is held.
    """
    sep = "\n" * gap

    def begin(*key):
        return [key, 0, None]

    def step(state: list, text: str):
        key, n, open_ = state
        if open_ is None:
            state[2] = text
        elif len(both := open_ + sep + text) <= limit:
            state[2] = both
        else:
            yield *key, n, open_
            state[1:] = n + 1, text

    def end(state: list):
        key, n, open_ = state
        yield *key, n, open_

    kinds = ", ".join(f"`{k}` {lines.schema[k].dataType.simpleString()}" for k in keys)
    return ordered.walked(lines.where("text is not null"), keys, ["ord", "text"], ["text"], f"{kinds}, message int, body string", begin, step, end)


#: Fixed value: what a view without rows says.
NOTHING = "Событий нет."


def views(headers: DataFrame, blocks: DataFrame, keys: list[str], limit: int = 3900) -> DataFrame:
    """Messages of a view: keys, message (from 0), body; the header is repeated in each, the footer stands in the last if it fits there.

    ``headers``: keys, header, footer, one row for each view; ``blocks``: keys, ord, text.  A block that
    does not fit behind the header alone stays with it; a view without blocks is one message that says so.
    """
    rows = headers.join(blocks.where("text is not null").select(*keys, "ord", "text"), keys, "left")

    def begin(*key):
        return [key, 0, None, "", ""]

    def step(state: list, text: str | None, header: str, footer: str | None):
        key, n, open_, _, _ = state
        state[3:] = header, footer or ""
        if text is None:
            state[2] = f"{header}\n\n{NOTHING}{footer or ''}"
            state[4] = ""
        elif len(both := f"{header if open_ is None else open_}\n\n{text}") > limit and open_ is not None:
            yield *key, n, open_
            state[1:3] = n + 1, f"{header}\n\n{text}"
        else:
            state[2] = both

    def end(state: list):
        key, n, open_, _, footer = state
        yield *key, n, open_ + footer if len(open_) + len(footer) <= limit else open_

    kinds = ", ".join(f"`{k}` {headers.schema[k].dataType.simpleString()}" for k in keys)
    return ordered.walked(rows, keys, ["ord", "text"], ["text", "header", "footer"], f"{kinds}, message int, body string", begin, step, end)
