"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, langid, licenses, neardup, packing, pii, quality, resample, search, sharding, tokencount, warc
from .common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op9_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.section_tokens(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_neardup": op2_neardup,
        "op3_packing": op3_packing,
        "op4_quality": op4_quality,
        "op5_sharding": op5_sharding,
        "op6_langid": op6_langid,
        "op7_licenses": op7_licenses,
        "op8_pii": op8_pii,
        "op9_tokencount": op9_tokencount,
        "op10_decontaminate": op10_decontaminate,
        "op11_resample": op11_resample,
        "op12_search": op12_search,
        "op13_bpe": op13_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.ORACLE_SQL,
        "op4_quality": quality.oracle_sql(),
        "op11_resample": resample.ORACLE_SQL,
        "op12_search": search.ORACLE_SQL,
    }
