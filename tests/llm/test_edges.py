"""Nulls, empty and very long texts, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import pytest

import corpus_pipeline
from airgrid.llm import decontaminate, langid, licenses, neardup, packing, pii, quality, sharding, tokencount, warc

WORDS = " ".join(f"word{i % 97}x{i // 97}" for i in range(120))
ODD = [
    (1, WORDS, "en", "h1", 5), (1, WORDS, "en", "h1", 5), (2, WORDS, None, None, None), (None, WORDS, "en", "h2", 1), (None, None, None, None, None),
    (3, None, "en", "h1", 0), (4, "", "de", "h1", 0), (5, " \n\t ", "de", "", 3), (6, "… — 1.2.3.4 a@b.c", "fr", "h3", 9), (7, "lang " * 60_000, "en", "h1", 1),
    (8, "x" * 200_000, "de", "h1", 1), (9, "the 😀 of\r\n é", "en", "h4", 1), (10, WORDS + " end", "en", "h1", 1), (11, "Licensed under the MIT License.\n\nabc", "en", "h1", 1),
]
BENCH = [(1, " ".join(WORDS.split()[20:40])), (None, "of"), (2, None), (3, ""), (1, "the 😀 of")]
#: Names that operators use within.
EXTRA = ("quality", "contamination", "key", "spans", "sequence_id", "more", "node", "bands", "label", "Held_Out", "_run", "piece", "_bad", "_key", "_row", "_spans", "n", "_more", "verdict", "_verdict", "_host", "_n", "host", "_h", "owner", "shard", "slot", "run", "size", "row.key")
#: Columns that a result has for each document, whatever else it has.
OPERATORS = {
    "op2": neardup.classes, "op3": packing.pack_documents, "op4": quality.judged, "op5": sharding.shard_documents, "op6": langid.identify, "op7": licenses.license_scan, "op8": pii.personal_data, "op9": tokencount.section_tokens,
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    from pyspark.sql import functions as F

    d = tmp_path_factory.mktemp("odd")
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    for c in EXTRA:
        docs = docs.withColumn(c, F.lit(c))
    docs.write.parquet(f"{d}/odd/documents.parquet")
    docs.limit(0).write.parquet(f"{d}/none/documents.parquet")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    bench.write.parquet(f"{d}/odd/benchmark.parquet")
    bench.limit(0).write.parquet(f"{d}/none/benchmark.parquet")
    return d


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_documents(spark, folder, name):
    got = OPERATORS[name](spark.read.parquet(f"{folder}/odd/documents.parquet")).collect()
    assert sorted({str(r.doc_id) for r in got}) == sorted({str(r[0]) for r in ODD})
    if name not in ("op3", "op9"):  # those have a row per piece or section
        assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    if name == "op2":
        assert by[1].class_id == by[2].class_id == by[10].class_id == 1 and by[3].class_id == 3 and by[4].class_id == 4
    if name == "op3":
        assert by[3].length == by[4].length == 1
    if name == "op4":
        assert by[3].n_words == by[5].n_words == 0 and by[3].base_failed and by[7].n_repeat_words == 60_000
    if name == "op5":
        assert by[3].size == 8 and by[8].size == 200_008
    if name == "op6":
        assert [by[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3
    if name == "op7":
        assert by[11].licenses == "MIT" and by[3].n_notices == 0
    if name == "op8":
        assert by[6].spans == "ip:4:11,email:12:17" and by[3].spans == ""
    if name == "op9":
        assert by[3].n_tokens == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_no_documents(spark, folder, name):
    assert OPERATORS[name](spark.read.parquet(f"{folder}/none/documents.parquet")).count() == 0


def test_odd_benchmark(spark, folder):
    docs = spark.read.parquet(f"{folder}/odd/documents.parquet")
    got = decontaminate.digest(docs, spark.read.parquet(f"{folder}/odd/benchmark.parquet")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ODD) and by[1].n_hit == 20 and by[1].n_items == 1 and by[9].n_hit == 3 and by[3].n_words == 0
    assert decontaminate.digest(docs, spark.read.parquet(f"{folder}/none/benchmark.parquet")).where("contaminated").count() == 0
    assert decontaminate.digest(docs.limit(0), spark.read.parquet(f"{folder}/odd/benchmark.parquet")).count() == 0


def test_a_text_full_of_cues_and_of_addresses(spark):
    """Very long texts of nothing but cue words, addresses or one line are handled whole."""
    long = [(1, "license copyright " * 20_000), (2, "a@b.c " * 20_000), (3, "1.1.1.1 +1 (650) 555-1234 " * 5_000), (4, "\n" * 100_000), (5, "x\n" * 50_000)]
    docs = spark.createDataFrame(long, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert (got[2].n_email, got[3].n_ip, got[3].n_phone) == (20_000, 5_000, 5_000) and got[3].spans.startswith("ip:0:7,phone:8:33,ip:26:33")
    assert {r.doc_id: r.n_notices for r in licenses.license_scan(docs).collect()} == dict.fromkeys(range(1, 6), 0)
    assert {r.doc_id: r.n_dup_lines for r in quality.judged(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 49_999}


def test_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("which", ["odd", "none"])
def test_stages(spark, folder, which):
    """Every stage takes the odd table by itself and keeps its columns; the run goes through."""
    sf_dir = f"{folder}/{which}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns, name
        rows = got.collect()
        if which == "none":
            assert rows == []
        elif name == "quality rules":
            assert {r.doc_id for r in rows} == {1, 2, None, 10}
        elif name == "near duplicates":
            assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "None", "None", "3", "4", "5", "6", "7", "8", "9", "11"])
        elif name == "benchmark decontamination":
            assert {r.doc_id for r in rows} & {1, 2, 9, 10} == set()
        else:
            assert len(rows) == len(ODD) and next(r.text for r in rows if r.doc_id == 6) == "… — [IP] [EMAIL]"
    # of what the rules leave (copies of one text) one id and the row without an id stay, and those hold a benchmark text
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
