"""Host-level quality rules, in DataFrame functions only.

Each document is measured; four rules say whether it fails.  Failures are summed by
host (``source``), partial sums first, so that a host with a third of all rows is no
burden.  Each rule's rate is shrunk by a beta prior that is fitted to all hosts by
moments (``shrunk_rates``) and worth an average host's documents at most: a host with few documents
stays near the corpus rate, and one with many is known by its own.

Verdicts compare a host with the corpus, never with a fixed rate:

* A host is bad where the odds that its documents fail a rule are more than ``BAD_ODDS`` times
  the corpus's, even at the lower bound of its posterior (``DEVIATIONS`` standard deviations
  below the mean).  All of its documents go.
* For the rules that a lone document may break by chance (symbols, repeated lines) the host decides
  on doubtful documents.  Where the mean of its posterior is under the prior's quantile of 0.4, the
  host is trusted with a rule, and a document stays up to ``LENIENT`` times the rule's limit; where it is
  over the quantile of 0.6, a document goes from ``STRICT`` times the limit on; between them the limit
  is the rule's own.

Where hosts hardly differ, so do their posteriors, but not in order: those that did worse than most are still
the ones whose doubtful documents go.

Defined cases: a null text has no words and fails the length rule; a null source is a
host of its own; repeated rows and equal hosts count each; very long texts are measured
whole; a table without a source column is of one host; columns of any name are kept as
they are; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_by_share, let, named, stored

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words in windows found twice
MAX_SYMBOLS = 10  # symbols to 100 characters of words
MAX_DUP_LINES = 30  # per cent of lines with a word
#: A bad host's odds of failing a rule, as a multiple of the corpus's.
BAD_ODDS = 20.0
#: Standard deviations of the posterior that a bad host must be above that.
DEVIATIONS = 2.0
#: What a rule's limit is multiplied by for hosts that are trusted with it, and for hosts that are not.
LENIENT, STRICT = 2.0, 2 / 3
#: The prior's quantiles of 0.4 and 0.6, in its standard deviations from the mean.
QUANTILE = 0.2533471
#: Documents that the prior is worth at least: those of a uniform one.
UNIFORM = 2.0
RULES = ("short", "repeated", "symbols", "dup_lines")
#: Rules with a limit for each host.
SOFT = {"symbols": MAX_SYMBOLS, "dup_lines": MAX_DUP_LINES}

SPACE = r"[ \t-\r]"


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def repeated_words(w: Column, k: int = 3) -> Column:
    """How many words lie in windows of ``k`` words that occur twice or more in the text; ``w``: a bound variable.

    Window hashes are sorted with their places; neighbours that are equal are repeats,
    and the places of repeats, sorted, cover min(k, distance to the next) words each.
    """
    n = F.size(w) - (k - 1)

    def windows(h: Column) -> Column:
        runs = F.transform(F.slice(h, 1, n), lambda x, i: F.struct(F.xxhash64(x, *(F.get(h, i + j) for j in range(1, k))).alias("h"), i.alias("i")))
        return F.sort_array(runs)

    def repeats(a: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(a, i)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(a, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-k).alias("last"))
        return F.aggregate(p, start, lambda s, x: F.struct((s["n"] + F.least(F.lit(k), x - s["last"])).alias("n"), x.alias("last")), lambda s: s["n"])

    found = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(windows(h), lambda a: let(repeats(a), covered)))
    return F.when(n < 2, F.lit(0).cast("long")).otherwise(found)


def measured(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct column more: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = fresh(docs.columns, "quality")
    long = lambda c: c.cast("long")
    by_words = let(words(text), lambda w: F.struct(long(F.size(w)).alias("n_words"), long(F.length(F.array_join(w, ""))).alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    by_lines = let(lines, lambda a: F.struct(long(F.size(a)).alias("n_lines"), long(F.size(a) - F.size(F.array_distinct(a))).alias("n_dup_lines")))
    symbols = long(F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", "")))
    return docs.withColumn(name, F.struct(by_words.alias("w"), by_lines.alias("l"), symbols.alias("n_symbols"))), name


def measure(quality_col: str, what: str) -> Column:
    part = {"n_symbols": "", "n_lines": ".l", "n_dup_lines": ".l"}.get(what, ".w")
    return F.col(f"{quality_col}{part}.{what}")


def failures(q: str) -> dict[str, Column]:
    """Which rules a measured document fails."""
    m = lambda what: measure(q, what)
    return {
        "short": m("n_words") < MIN_WORDS,
        "repeated": 100 * m("n_repeat_words") > MAX_REPEATED * m("n_words"),
        "symbols": 100 * m("n_symbols") > MAX_SYMBOLS * m("word_chars"),
        "dup_lines": 100 * m("n_dup_lines") > MAX_DUP_LINES * m("n_lines"),
    }


def shrunk_rates(hosts: DataFrame, rules=RULES) -> DataFrame:
    """``hosts`` (n and a count for each rule) with, for each rule, rate_<rule> and low_<rule> (mean of the posterior under a beta prior, and DEVIATIONS below it), pooled_<rule> and prior_sd_<rule>.

    The prior has the pooled rate m and, by the moments of the hosts' rates r (weighted by n),
    the strength s = m (1 - m) / v - 1, with v their variance beyond what binomial draws explain; it is
    worth an average host's documents at most.
    """
    total, more = [F.sum("n").alias("_n"), F.count("*").alias("_hosts"), F.sum(F.col("n") * F.col("n")).alias("_nn")], []
    for r in rules:
        rate = F.col(r) / F.col("n")
        total += [F.sum(r).alias(f"_{r}"), F.sum(F.col("n") * rate * rate).alias(f"_{r}2")]
    pooled = hosts.agg(*total)
    out = hosts.crossJoin(F.broadcast(pooled))  # one row
    for r in rules:
        m = F.col(f"_{r}") / F.col("_n")
        spread = F.col(f"_{r}2") / F.col("_n") - m * m
        chance = m * (1 - m) * (F.col("_hosts") - 1) / F.col("_n")
        scale = 1 - F.col("_nn") / (F.col("_n") * F.col("_n"))
        v = F.greatest((spread - chance) / F.greatest(scale, F.lit(1e-9)), F.lit(1e-9))
        s = F.greatest(F.least(m * (1 - m) / v - 1, F.col("_n") / F.col("_hosts")), F.lit(UNIFORM))
        mean = (F.col(r) + m * s) / (F.col("n") + s)
        more += [mean.alias(f"rate_{r}"), (mean - DEVIATIONS * F.sqrt(mean * (1 - mean) / (F.col("n") + s + 1))).alias(f"low_{r}"), m.alias(f"pooled_{r}"), F.sqrt(m * (1 - m) / (s + 1)).alias(f"prior_sd_{r}")]
    return out.select(*hosts.columns, *more)


def host_verdicts(rows: DataFrame, host_col: str, quality_col: str, bad_odds: float = BAD_ODDS) -> DataFrame:
    """One row per host: host, n, a count, rate_, low_ and pooled_ for each rule, bad, limit_<rule> for the soft rules."""
    fails = failures(quality_col)
    hosts = rows.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n"), *(F.count_if(c).alias(r) for r, c in fails.items()))
    rated = shrunk_rates(stored(hosts, "hosts"))
    worse = lambda r: F.col(f"low_{r}") * (1 - F.col(f"pooled_{r}")) > bad_odds * F.col(f"pooled_{r}") * (1 - F.col(f"low_{r}"))
    bad = worse(RULES[0])
    for r in RULES[1:]:
        bad = bad | worse(r)
    off = lambda r: F.col(f"rate_{r}") - F.col(f"pooled_{r}")
    edge = lambda r: QUANTILE * F.col(f"prior_sd_{r}")
    times = lambda r: F.when(off(r) < -edge(r), LENIENT).when(off(r) > edge(r), STRICT).otherwise(1.0)
    return stored(rated.withColumn("bad", bad).withColumns({f"limit_{r}": times(r) * limit for r, limit in SOFT.items()}), "host-verdicts")


def _host_key(host: Column) -> Column:
    """A null host is matched by null."""
    return F.coalesce(F.concat(F.lit("h"), host.cast("string")), F.lit(""))


def _joined(rows: DataFrame, verdicts: DataFrame, host_col: str, name: str) -> DataFrame:
    """``rows`` with a struct column ``name``: its host's bad and limits."""
    key = fresh(rows.columns, "_host")
    weight = fresh(rows.columns, "_n")
    slim = verdicts.select(_host_key(F.col("host")).alias(key), F.col("n").alias(weight), F.struct("bad", *(f"limit_{r}" for r in SOFT)).alias(name))
    total = verdicts.agg(F.sum("n")).first()[0] or 0
    return join_by_share(rows.withColumn(key, _host_key(F.col(host_col))), slim, key, weight, total, "inner").drop(key)


def base_failed(q: str) -> Column:
    fails = failures(q)
    return fails["short"] | fails["repeated"]


def rejected(q: str, verdict: str) -> Column:
    """The method's verdict on a measured document beyond the base rules: its host is bad, or it is over its host's limits."""
    m = lambda what: measure(q, what)
    of = lambda r: F.col(verdict)[f"limit_{r}"]
    return F.col(verdict)["bad"] | (100 * m("n_symbols") > of("symbols") * m("word_chars")) | (100 * m("n_dup_lines") > of("dup_lines") * m("n_lines"))


def judged(docs: DataFrame, host_col: str = "source", bad_odds: float = BAD_ODDS) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_bad, kept."""
    host = F.col(host_col) if host_col in docs.columns else F.lit(None).cast("string")
    rows, q = measured(docs.select("doc_id", "text", host.alias("host")))
    rows = stored(rows.drop("text"), "quality")
    out = _joined(rows, host_verdicts(rows, "host", q, bad_odds), "host", "verdict")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    failed = base_failed(q)
    return out.select("doc_id", *(measure(q, x).alias(x) for x in names), failed.alias("base_failed"), F.col("verdict.bad").alias("host_bad"), (~failed & ~rejected(q, "verdict")).alias("kept"))


def keep_good(docs: DataFrame, host_col: str = "source", bad_odds: float = BAD_ODDS) -> DataFrame:
    """``docs`` without those that fail the base rules, come from a bad host or are over their host's limits.

    The measures are stored with the documents once, so that the text is not measured twice.
    """
    rows, q = measured(docs)
    if host_col not in docs.columns:
        rows = rows.withColumn(host_col, F.lit(None).cast("string"))
    rows = stored(rows, "quality")
    verdict = fresh(rows.columns, "_verdict")
    return _joined(rows.where(~base_failed(q)), host_verdicts(rows, host_col, q, bad_odds), host_col, verdict).where(~rejected(q, verdict)).select(*named(docs.columns))


def oracle_sql(host_col: str = "source") -> str:
    """``judged`` as DuckDB SQL over documents."""
    fails = {
        "short": f"n_words < {MIN_WORDS}",
        "repeated": f"100 * n_repeat_words > {MAX_REPEATED} * n_words",
        "symbols": f"100 * n_symbols > {MAX_SYMBOLS} * word_chars",
        "dup_lines": f"100 * n_dup_lines > {MAX_DUP_LINES} * n_lines",
    }
    rules, sums = list(fails), "sum(n)"
    pooled = ", ".join(f"sum({r}) / {sums} AS m_{r}, sum(n * (cast({r} AS DOUBLE) / n) * (cast({r} AS DOUBLE) / n)) / {sums} AS q_{r}" for r in rules)
    strength = ", ".join(f"greatest(least(m_{r} * (1 - m_{r}) / greatest((q_{r} - m_{r} * m_{r} - m_{r} * (1 - m_{r}) * (hosts - 1) / total) / greatest(1 - nn / (total * total), 1e-9), 1e-9) - 1, total / hosts), {UNIFORM}) AS s_{r}" for r in rules)
    rate = ", ".join(f"({r} + m_{r} * s_{r}) / (n + s_{r}) AS r_{r}" for r in rules)
    low = ", ".join(f"r_{r} - {DEVIATIONS} * sqrt(r_{r} * (1 - r_{r}) / (n + s_{r} + 1)) AS l_{r}" for r in rules)
    bad = " OR ".join(f"l_{r} * (1 - m_{r}) > {BAD_ODDS} * m_{r} * (1 - l_{r})" for r in rules)
    edge = lambda r: f"{QUANTILE} * sqrt(m_{r} * (1 - m_{r}) / (s_{r} + 1))"
    double = lambda x: f"CAST({x!r} AS DOUBLE)"  # noqa: E731  a bare number is a decimal there
    limit = ", ".join(f"CASE WHEN r_{r} - m_{r} < -({edge(r)}) THEN {double(LENIENT * n)} WHEN r_{r} - m_{r} > {edge(r)} THEN {double(STRICT * n)} ELSE {double(1.0 * n)} END AS limit_{r}" for r, n in SOFT.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {host_col} AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
twice AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, gram) AS k FROM g WHERE gram IS NOT NULL) WHERE k > 1),
r AS (SELECT id, count(DISTINCT i + j) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS v(j) GROUP BY id),
ww AS (SELECT id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY id),
l AS (SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id),
m AS (
  SELECT id, doc_id, host, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM d LEFT JOIN ww USING (id) LEFT JOIN l USING (id) LEFT JOIN r USING (id)),
h AS (SELECT host, count(*) AS n, {", ".join(f"count(*) FILTER ({c}) AS {r}" for r, c in fails.items())} FROM m GROUP BY host),
p AS (SELECT cast(sum(n) AS DOUBLE) AS total, count(*) AS hosts, cast(sum(n * n) AS DOUBLE) AS nn, {pooled} FROM h),
s AS (SELECT h.*, p.*, {strength} FROM h, p),
f AS (SELECT *, {rate} FROM s),
b AS (SELECT *, {low} FROM f),
v AS (SELECT host, {bad} AS host_bad, {limit} FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_bad,
  NOT base_failed AND NOT host_bad AND NOT 100 * n_symbols > limit_symbols * word_chars AND NOT 100 * n_dup_lines > limit_dup_lines * n_lines AS kept
FROM (SELECT m.*, v.host_bad, limit_symbols, limit_dup_lines, {fails["short"]} OR {fails["repeated"]} AS base_failed FROM m JOIN v ON m.host IS NOT DISTINCT FROM v.host)
"""
