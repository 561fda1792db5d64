"""HTML as rows.  Spark has no parser of it, so pages go through Arrow batches to the standard one."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon
from .shared import settled

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style", "template"))
_ELEMENT = [("ord", pa.int32(), "int"), ("parent", pa.int32(), "int"), ("last", pa.int32(), "int"), ("tag", pa.string(), "string"), ("attrs", pa.map_(pa.string(), pa.string()), "map<string,string>"), ("text", pa.string(), "string"), ("within", pa.int32(), "int")]
#: Rows and characters that a worker holds as Python's own before they become Arrow columns.
ROWS, CHARS = 4096, 1 << 22


class Tree(HTMLParser):
    """Elements in order, each with its parent, its last descendant, attributes, the text nodes in it and the nearest ``within`` around it; text outside scripts and styles only.

    ``closed`` takes each element when it is complete; without it all are kept in ``rows``.
    """

    def __init__(self, closed: Callable[[list], None] | None = None, within: str = "") -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[list] = []
        self.nodes: list[tuple[int, str]] = []
        self.before: list[int] = []
        self.count = 0
        self.closed, self.within = closed, within

    def handle_starttag(self, tag, attrs):
        n, up = self.count, self.open[-1] if self.open else None
        around = -1 if up is None else up[0] if up[3] == self.within else up[6]
        row = [n, -1 if up is None else up[0], n, tag, [(k, v or "") for k, v in dict(attrs).items()], [], around]
        self.count += 1
        if self.closed is None:
            self.rows.append(row)
        if tag not in VOID:
            self.open.append(row)
        elif self.closed:
            self.closed(row)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.shut(len(self.open) - 1)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][3] == tag:
                self.shut(i)
                return

    def shut(self, i: int) -> None:
        """The open elements from the ``i``-th on end here: all that was opened since is in them."""
        for row in self.open[i:]:
            row[2] = self.count - 1
            if self.closed:
                self.closed(row)
        del self.open[i:]

    def handle_data(self, data):
        text = " ".join(data.split())
        if text and not any(row[3] in HIDDEN for row in self.open):
            self.nodes.append((self.open[-1][0] if self.open else -1, text))
            self.before.append(self.count)
            for row in self.open:
                row[5].append(text)

    def close(self):
        super().close()
        self.shut(0)


def parsed(html: str | None, closed: Callable[[list], None] | None = None, within: str = "") -> Tree:
    tree = Tree(closed, within)
    tree.feed(html or "")
    tree.close()
    return tree


class Packed:
    """Rows as Arrow columns, some thousands at a time: a page's rows are then about as large as the page."""

    def __init__(self, kinds: list[pa.DataType]) -> None:
        self.kinds, self.rows, self.chars, self.done = kinds, [], 0, []

    def add(self, *row) -> None:
        self.rows.append(row)
        self.chars += sum(len(x) for x in row if isinstance(x, str))
        if len(self.rows) >= ROWS or self.chars >= CHARS:
            self.pack()

    def pack(self) -> None:
        if self.rows:
            self.done.append([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), self.kinds, strict=True)])
        self.rows, self.chars = [], 0

    def taken(self) -> list[list[pa.Array]]:
        done, self.done = self.done, []
        return done


def _emitted(pages: DataFrame, key: str, html: str, fields: list[tuple[str, pa.DataType, str]], find: Callable) -> DataFrame:
    """key and ``fields``: what ``find`` adds for each page.  A worker holds one page at a time, and hands its rows on before the next."""
    schema = T.StructType([pages.schema[key], *(T.StructField(n, T._parse_datatype_string(t)) for n, _, t in fields)])

    def work(batches):
        for batch in batches:
            made = lambda columns: pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], names=schema.names)  # noqa: B023, E731
            packed = Packed([pa.int64(), *(t for _, t, _ in fields)])
            for i, page in enumerate(batch.column(1)):
                find(page.as_py(), partial(packed.add, i))
                yield from map(made, packed.taken())
            packed.pack()
            yield from map(made, packed.taken())

    return pages.select(key, html).mapInArrow(work, schema)


def elements(pages: DataFrame, key: str, html: str, tags: tuple[str, ...] = (), within: str = "") -> DataFrame:
    """key, ord, parent, last, tag, attrs, text (its text nodes, joined by spaces); of all tags, or those given.  ``within``: a tag; one more column has the nearest element of it around each, or -1."""

    def find(page, add):
        def closed(row):
            if not tags or row[3] in tags:
                add(*row[:5], " ".join(row[5]), *row[6 : 6 + bool(within)])

        parsed(page, closed, within)

    return _emitted(pages, key, html, _ELEMENT if within else _ELEMENT[:-1], find)


def following(rows: DataFrame, key: str, **marks: tuple[Column, Column]) -> DataFrame:
    """``rows`` (key, ord, ...) and for each of ``marks`` (which rows, what of them) what the next such row after each has; null behind the last.

    What stands within an element follows it and ends with its last: so the first of a kind in an element
    is the next of that kind, if that is not behind its last.  A page is sorted backwards and gone through once.
    """
    behind = Window.partitionBy(key).orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({name: F.last(F.when(which, what), ignorenulls=True).over(behind) for name, (which, what) in marks.items()})


def text_nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, ord, text: the visible text nodes in order."""

    def find(page, add):
        for k, (_, text) in enumerate(parsed(page, _dropped).nodes):
            add(k, text)

    return _emitted(pages, key, html, [("ord", pa.int32(), "int"), ("text", pa.string(), "string")], find)


def placed_nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, node, text, after: the visible text nodes in order; ``after`` is how many elements were opened before each."""

    def find(page, add):
        tree = parsed(page, _dropped)
        for k, ((_, text), n) in enumerate(zip(tree.nodes, tree.before, strict=True)):
            add(k, text, n)

    return _emitted(pages, key, html, [("node", pa.int32(), "int"), ("text", pa.string(), "string"), ("after", pa.int32(), "int")], find)


def _dropped(row: list) -> None:
    """For those who want text only."""


def cards(pages: DataFrame, key: str, html: str, href: str, clock: str, status: str, levels: int = 8, longest: int = 1400) -> DataFrame:
    """key, ord, href, label, said: links whose target matches, each with the text of the element around it that has a clock.

    Of up to ``levels`` elements around a link, those of at most ``longest`` characters that have a clock count, up to the
    first with a status; the last of them is its text, or its own where none counts.
    """

    def around(tree: Tree, row: list) -> str:
        best, at = " ".join(row[5]), row[1]
        for _ in range(levels):
            if at < 0:
                break
            nodes, at = tree.rows[at][5], tree.rows[at][1]
            if 2 * len(nodes) - 1 > longest:  # too long, whatever they say
                continue
            text = " ".join(nodes)
            if text and len(text) <= longest and re.search(clock, text):
                best = text
                if re.search(status, text, re.I):
                    break
        return best

    def find(page, add):
        tree = parsed(page)
        for r in tree.rows:
            if r[3] == "a" and re.search(href, dict(r[4]).get("href", "")):
                add(r[0], dict(r[4])["href"], " ".join(r[5]), around(tree, r))

    return _emitted(pages, key, html, [("ord", pa.int32(), "int"), *((n, pa.string(), "string") for n in ("href", "label", "said"))], find)


def asset_hints(pages: DataFrame, key: str, html: str, tags: tuple[str, ...]) -> DataFrame:
    """key, ord, tag, hints: for each element of the given tags the hints in attributes of itself and of all below it, in order, each once.

    An element's descendants are those with numbers from its own to its last; a class is as many hints as it has names.
    """
    every = settled(elements(pages, key, html).select(key, "ord", "last", "tag", "attrs"), "elements")
    named = F.filter(F.map_entries("attrs"), lambda a: a["key"].isin(*lexicon.HINT_ATTRIBUTES) | a["key"].startswith("data-"))
    values = F.flatten(F.transform(named, lambda a: F.when(a["key"] == "class", F.split(F.btrim(F.regexp_replace(a["value"], r"\s+", " ")), " ")).otherwise(F.array(a["value"]))))
    below = every.select(F.col(key).alias("_key"), F.col("ord").alias("_ord"), F.filter(values, lambda x: x != "").alias("_hints")).where(F.size("_hints") > 0)
    outer = every.where(F.col("tag").isin(*tags)).select(key, "ord", "last", "tag")
    within = outer.join(below, (F.col(key) == F.col("_key")) & F.col("_ord").between(F.col("ord"), F.col("last")), "left")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_ord", "_hints"))), lambda x: x["_hints"])
    return within.groupBy(key, "ord", "tag").agg(F.array_distinct(F.flatten(F.filter(ordered, lambda x: x.isNotNull()))).alias("hints"))


def signature(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, signature: a digest of the visible text, blind to markup."""
    nodes = text_nodes(pages, key, html)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    return nodes.groupBy(key).agg(F.sha2(joined, 256).alias("signature"))
