"""All queries of the library and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import basic, checked, claims, composed, guided, joined, scanned, told, web

_ALL = basic.QUERIES | joined.QUERIES | scanned.QUERIES | told.QUERIES | guided.QUERIES | checked.QUERIES | claims.QUERIES | composed.QUERIES | web.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
