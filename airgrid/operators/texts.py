"""What is made of texts alone, worked out once for each different text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled


def made_once(rows: DataFrame, texts: list[str], made: dict[str, Column]) -> DataFrame:
    """``rows`` with the columns ``made`` of ``texts`` and nothing else, each worked out once for every different combination of these.

    A guide names the same events, channels and sports over and over, and patterns cost far more than a join.
    What is made is stored, so whether it is broadcast goes by its size; nulls are texts like others.
    """
    known = settled(rows.select(*texts).distinct().withColumns(made).withColumnsRenamed({c: f"_of_{c}" for c in texts}), "texts")
    same = F.expr(" and ".join(f"`{c}` <=> `_of_{c}`" for c in texts))
    return rows.join(known, same).drop(*(f"_of_{c}" for c in texts))
