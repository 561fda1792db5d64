"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Patterns find the protected entities: e-mail and IP addresses, payment cards, phone numbers.
The corpus then says which terms give an entity away.  For a term t and an entity e,
information about e is IC(e) = -log2 p(e), and t discloses PMI(e; t) = log2 p(e | t) / p(e)
of it; p are shares of all documents, and e and t occur together when t stands in a line with
e, at most ``NEAR`` words away.  p(e | t) is a smoothed lower bound: seen together in k
different lines, it is k / (k + 1) of the share of the term's documents, so a single line
leaves one bit in doubt.  A term that discloses at least ``DISCLOSURE`` of an entity's
information is removed from the documents that hold the entity.  Every word is a term, of any
script and length, with or without digits, compared without case.  Only one to three small
letters ("at") must stand with the entity in capitals ("Kim") at least once.

Patterns are written so that a match is the leftmost one and no text, however long, makes them
recurse or look at a character more than a few times: possessive, and anchored to the start of
a run of characters or the end of the match before.

Defined cases: a null text is empty and has no spans (its masked text stays null); repeated
rows get equal results and count each in p; in a corpus of few documents an entity has little
information, and more lines are asked for (102 documents for one line, 15 for two); equal spans of two kinds both stay;
columns of any name are kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, small_or_join, stored

DISCLOSURE = 0.85
#: Words on either side of an entity, within its line.
NEAR = 8
TERM = r"[\p{L}\p{M}\p{N}]+"
SMALL = r"^\p{Ll}{1,3}$"
TERM_ORDER = 4
SPAN = "array<struct<start:long,order:int,kind:string,end:long,value:string>>"
SLIM_ROWS = 20_000

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


#: kind, pattern, whether a text can have one at all, whether a match counts
KINDS = (
    ("email", EMAIL, lambda t: t.contains("@"), lambda m: F.lit(True)),
    ("ip", IP, lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")),
    ("card", CARD, lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){13}"), lambda m: F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", F.when(F.length(_digits(m)).between(14, 19), _digits(m)).otherwise("0"))),
    ("phone", PHONE, lambda t: t.contains("+"), lambda m: F.length(_digits(m)).between(10, 15)),
)


def running(numbers: Column) -> Column:
    """Running sums of an array, in blocks of about the square root of its length, so that no long array is copied for each number; ``numbers``: a bound variable."""
    n = F.size(numbers)
    block = F.greatest(F.ceil(F.sqrt(n)), F.lit(1)).cast("int")
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("sums"))
    sums = lambda a: F.aggregate(a, begin, lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["sums"], s["at"] + x).alias("sums")), lambda s: s["sums"])
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, block)).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda i: sums(F.slice(numbers, i + 1, block)))
    whole = lambda bs: let(sums(F.transform(bs, lambda x: F.element_at(x, -1))), lambda ends: F.flatten(F.transform(bs, lambda x, i: F.transform(x, lambda y: y + F.coalesce(F.get(ends, i - 1), F.lit(0).cast("long"))))))
    return let(blocks, whole)


def located(text: Column, pattern: str, can: Column) -> Column:
    """Start, end (code points, end exclusive) and value of each match, in order."""
    none = F.array().cast("array<string>")
    matches = F.when(can, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)

    def placed(m: Column) -> Column:
        gaps = F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(none)
        steps = lambda g: F.transform(m, lambda x, i: (F.length(F.get(g, i)) + F.length(x)).cast("long"))
        ends = let(let(gaps, steps), running)
        return F.zip_with(m, ends, lambda x, end: F.struct((end - F.length(x)).alias("start"), end.alias("end"), x.alias("value")))

    return let(matches, placed)


def base_spans(text: Column) -> Column:
    """All spans of the four kinds, by start, then kind."""
    def of_kind(order: int, kind: str, pattern: str, can, good) -> Column:
        found = F.filter(located(text, pattern, can(text)), lambda x: good(x["value"]))
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))

    return F.array_sort(F.concat(*(of_kind(i, *k) for i, k in enumerate(KINDS)))).cast(SPAN)


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def entity(span: Column) -> Column:
    """The same for different spellings of one address or number."""
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"])))


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def near_terms(before: Column, after: Column, near: int) -> Column:
    """The distinct terms at most ``near`` words before or after, and for each spelling whether more than a few small letters."""
    # what holds the first words is cut off before words are told apart, so that a long line is not scanned whole for each of its entities
    sign = TERM.removesuffix("+").removeprefix("[").removesuffix("]")
    head = lambda x: F.regexp_extract(x, rf"^(?:[^{sign}]*+[{sign}]++){{0,{near}}}", 0)
    words = lambda x: F.regexp_extract_all(x, F.lit(TERM), F.lit(0))
    last, first = words(F.reverse(head(F.reverse(before)))), words(head(after))
    return F.array_distinct(F.transform(F.concat(last, first), lambda w: F.struct(F.lower(w).alias("term"), (~w.rlike(SMALL)).alias("named"))))


def term_counts(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n_term: how many documents (``text``) have each of ``terms`` (stored).

    Few terms are picked out before the shuffle.  Of many, all words of all documents are counted under a
    64-bit hash, one number a word and task, and the terms picked from the counts.
    """
    words = documents.select(F.explode(F.array_distinct(terms_of(F.coalesce("text", F.lit(""))))).alias("term"))
    if terms.limit(SLIM_ROWS + 1).count() <= SLIM_ROWS:
        return small_or_join(words, terms, "term", "left_semi", SLIM_ROWS).groupBy("term").agg(F.count("*").alias("n_term"))
    counts = words.groupBy(F.xxhash64("term").alias("_h")).agg(F.count("*").alias("n_term"))
    return terms.withColumn("_h", F.xxhash64("term")).join(counts, "_h").select("term", "n_term")


def disclosing(documents: DataFrame, holders: DataFrame, disclosure: float = DISCLOSURE, near: int = NEAR) -> DataFrame:
    """entity, term: the terms that give an entity away.

    ``documents``: text, all of them.  ``holders``: key, text, spans, n: the texts that hold
    entities, each once, and how many documents have it.

    A pair discloses enough if and only if the term is in at most
    n_both k / (k + 1) (n / n_entity) ** (1 - disclosure) documents.
    """
    n = F.lit(float(max(documents.count(), 1)))
    spans = holders.select("key", "text", "n", F.explode("spans").alias("s"))
    before = F.substring_index(F.substring(F.col("text"), F.lit(1), F.col("s.start").cast("int")), "\n", -1)
    after = F.substring_index(F.substring(F.col("text"), F.col("s.end").cast("int") + 1, F.length("text")), "\n", 1)
    line_hash = F.xxhash64(F.replace(F.concat(before, F.col("s.value"), after), F.col("s.value"), F.lit(" ")))
    lines = stored(spans.select("key", "n", entity(F.col("s")).alias("entity"), near_terms(before, after, near).alias("terms"), line_hash.alias("line_hash")), "entity-lines")
    # an entity counts once for each document; if even a term of its own in all its lines would not do, it goes no further
    room = F.pow(n / F.col("n_entity"), F.lit(1 - disclosure)) * (1 + 1e-9)
    sure = F.col("k") / (F.col("k") + 1)
    per_text = lines.groupBy("entity", "key").agg(F.first("n").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_entity"))
    different = lines.groupBy("entity", "line_hash").agg(F.lit(1)).groupBy("entity").agg(F.count("*").alias("k"))
    enough = stored(per_text.join(different, "entity").where(sure * room >= 1).select("entity", "n_entity"), "entities")
    seen = small_or_join(lines, enough, "entity", "inner").select("entity", "n_entity", "key", "n", "line_hash", F.inline("terms"))
    # all lines count, also several of one text and those that texts share; documents count once for each text
    often = seen.groupBy("entity", "term", "line_hash").agg(F.max("named").alias("named")).groupBy("entity", "term").agg(F.count("*").alias("k"), F.max("named").alias("named")).where("named").drop("named")
    both = seen.groupBy("entity", "n_entity", "term", "key").agg(F.first("n").alias("n")).groupBy("entity", "n_entity", "term").agg(F.sum("n").alias("n_both"))
    pairs = both.join(often, ["entity", "term"]).select("entity", "term", (F.col("n_both") * sure * room).alias("most")).where(F.col("most") >= 1)
    # The lines with entities alone show for most terms that they are in more documents; only the rest are counted in all texts.
    known = lines.select("key", "n", F.explode(F.array_distinct(F.transform("terms", lambda t: t["term"]))).alias("term")).groupBy("term", "key").agg(F.first("n").alias("n"))
    known = known.groupBy("term").agg(F.sum("n").alias("n_near"))
    pairs = stored(pairs.join(known, "term").where(F.col("n_near") <= F.col("most")).drop("n_near"), "pairs")
    terms = stored(pairs.select("term").distinct(), "terms")
    return stored(pairs.join(term_counts(documents, terms), "term").where(F.col("n_term") <= F.col("most")).select("entity", "term"), "disclosing")


def term_spans(holders: DataFrame, disclosed: DataFrame) -> DataFrame:
    """key, more: the spans of disclosing terms in the texts that hold their entities, outside base spans."""
    of = holders.select("key", F.explode(F.array_distinct(F.transform("spans", entity))).alias("entity"))
    sets = small_or_join(of, disclosed, "entity", "inner").groupBy("key").agg(F.collect_set("term").alias("terms"))
    rows = holders.join(sets, "key")
    found = located(F.col("text"), TERM, F.lit(True))
    free = lambda x: ~F.exists("spans", lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"]))
    kept = F.filter(F.filter(found, lambda x: F.array_contains("terms", F.lower(x["value"]))), free)
    span = lambda x: F.struct(x["start"].alias("start"), F.lit(TERM_ORDER).alias("order"), F.lit("term").alias("kind"), x["end"].alias("end"), x["value"].alias("value"))
    return rows.select("key", F.transform(kept, span).cast(SPAN).alias("more"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are one, under the first one's kind."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(s: Column, x: Column) -> Column:
        plain = F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        fresh_span = x["start"] >= s["at"]
        return F.struct(F.when(fresh_span, F.concat(s["out"], plain, F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(s["out"]).alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))


def _found(docs: DataFrame, columns: list, **options) -> tuple[DataFrame, DataFrame]:
    """``columns`` with key and base spans of each row, and key with term spans for texts that have some."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*columns, F.sha2(text, 256).alias("_key"), text.alias("_text"), base_spans(text).alias("_spans"))
    rows = stored(rows.withColumn("_text", F.when(F.size("_spans") > 0, F.col("_text"))), "spans")
    texts = rows.where(F.size("_spans") > 0).groupBy(F.col("_key").alias("key")).agg(F.first("_text").alias("text"), F.first("_spans").alias("spans"), F.count("*").cast("long").alias("n"))
    holders = stored(texts, "holders")
    disclosed = disclosing(docs.select("text"), holders, **options)
    return rows, stored(term_spans(holders, disclosed).where(F.size("more") > 0).select(F.col("key").alias("_key"), "more"), "term-spans")


def _with_terms(rows: DataFrame, more: DataFrame, name: str) -> DataFrame:
    """``rows`` with the term spans of their texts as ``name``; only rows that hold an entity are shuffled, and no spans are broadcast."""
    none = F.array().cast(SPAN)
    held = rows.where(F.size("_spans") > 0).join(more.withColumnRenamed("more", name), "_key", "left").withColumn(name, F.coalesce(name, none))
    return rows.where(F.size("_spans") == 0).withColumn(name, none).unionByName(held)


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    rows, more = _found(docs.select("doc_id", "text"), ["doc_id"], **options)
    out = _with_terms(rows.drop("_text"), more, "_more")
    every = F.array_sort(F.concat("_spans", "_more"))
    counts = [count_of("_spans", k[0]).alias(f"n_{k[0]}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(written(F.col("_spans")), 256).alias("base_sha256"), written(every).alias("spans"), F.size("_more").cast("long").alias("n_term"))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with spans of personal data and disclosing terms replaced in text; other columns and rows as they were."""
    rows, more = _found(docs, [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")], **options)
    out = _with_terms(rows, more, "_more")
    every = F.array_sort(F.concat("_spans", "_more"))
    text = F.when(F.size("_spans") > 0, masked(F.col("_text"), every)).otherwise(F.col("_row.text"))
    return out.select(*(text.alias(c) if c.lower() == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
