"""Large pages: rows are handed on in parts, and places within a page are found without pairs of all its elements."""

import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgrid.sources import guides, html, listings


class Worker:
    """Stands for a table of pages and gives the worker's function itself."""

    schema = T.StructType([T.StructField("page", T.LongType()), T.StructField("html", T.StringType())])

    def select(self, *_):
        return self

    def mapInArrow(self, work, _):
        return work


def test_rows_of_pages_are_handed_on_in_parts(spark):
    read = []

    class Pages(list):
        def __iter__(self):
            for x in super().__iter__():
                read.append(x)
                yield x

    page = "<ul>" + "<li><a href='x'>12:00 <b>one</b></a></li>" * 3000 + "</ul>"

    class Batch:
        def __init__(self):
            self.columns = [pa.array([1, 2, 3]), Pages(pa.array([page] * 3))]

        def column(self, i):
            return self.columns[i]

    for find, n in ((html.elements, 3 * 9001), (html.text_nodes, 3 * 6000), (html.placed_nodes, 3 * 6000)):
        read.clear()
        sizes, first = [], None
        for out in find(Worker(), "page", "html")([Batch()]):
            first = first or len(read)
            sizes.append(out.num_rows)
        assert sum(sizes) == n and max(sizes) <= 4096
        assert first == 1, "all pages were read before the first row was handed on"


def _joins(df):
    """Conditions of a plan's joins."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if re.search(r"\bJoin\b", line)]


def test_places_in_a_page_are_no_pairs(spark):
    pages = spark.createDataFrame([(1, "<p></p>", "2024-01-01")], "page long, html string, date string")
    for df in (guides.anchors(pages, "page", "html"), guides.on_air_times(pages, "page", "html"), listings.live_rows(pages, "page", "html", F.col("date").cast("date"), week=False)):
        assert not [j for j in _joins(df) if re.search(r"[<>]=? ?\w", j)]


def test_times_of_a_page_are_not_beside_each_of_its_rows(spark):
    pages = spark.createDataFrame([(1, '<a href="x">12:00 one <img src="/live.png"></a><i data-state="is live"></i><a href="x">13:00 two</a><a href="x">14:00 three</a>')], "page long, html string")
    got = guides.confirmed(guides.anchors(pages, "page", "html"), pages, "page", "html")
    assert [(r.time, r.method) for r in got.orderBy("time").collect()] == [("12:00", "official_live_badge"), ("13:00", "guide_page_live_text"), ("14:00", None)]
    assert "_times" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_list_item_and_its_first_clock(spark):
    inner = "<li><span>10:00</span><ul><li><span>11:00</span></li></ul><div class='blink'><a title='LIVE'></a></div></li>"
    nested = "<li><span>12:00</span><ul><li><span>x</span><span>13:00</span><div class='a blink'><i><a>live</a></i><a>no</a></div></li></ul></li>"
    other = "<li><span>14:00</span><div class='blink'><a>no</a><a>live</a></div></li><div class='blink'><a>live</a></div>"
    pages = spark.createDataFrame([(1, inner), (2, nested), (3, other)], "page long, html string")
    assert sorted(guides.on_air_times(pages, "page", "html").collect()) == [(1, "10:00"), (2, "13:00")]
