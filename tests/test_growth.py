"""Rows that only larger tables hold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rostra.functions import keys
from rostra.operators import extraction, quality, records, references, windows
from rostra.plans import documents, integrity, search
from rostra.plans import records as records_plan
from rostra.sources import packs, sinks


def test_parts_end_before_a_document_that_fits_into_none(spark):
    weights = spark.createDataFrame([(i, 41 if i == 5 else 20) for i in range(10)], "doc bigint, bytes bigint")
    with pytest.warns(UserWarning, match="document 5 needs 41 bytes"):
        got = sinks.pack_parts(weights, "doc", 40, refuse=False)
    assert {r.doc: r.part for r in got.collect()} == {0: 1, 1: 1, 2: 2, 3: 2, 4: 3}


@pytest.mark.parametrize("number", ["99999", "100000", "1234567890"])
def test_diary_numbers_of_many_digits(spark, number):
    said = spark.createDataFrame([(1, f"Protokoll Ks {number}/2024")], "id int, t string")
    assert said.select(extraction.diary_from_first_page(F.col("t"))).head()[0] == f"Ks {number}/2024"
    assert [(r.label, r.kind) for r in references.extract(said, "id", "t").collect()] == [(f"Ks {number}/2024", "diary")]


def test_ranges_of_large_numbers(spark):
    said = F.lit("Paragraf 59998–60000, 123456 och 9999-10001")
    assert spark.range(1).select(keys.expanded_ranges(said)).head()[0] == [9999, 10000, 10001, 59998, 59999, 60000, 123456]


def test_rows_of_document_0_are_not_judged_one_by_one(spark, tmp_path):
    spark.createDataFrame([(1, 0), (2, 7)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    items = [(k, n, 5, "A", "F") for k in (1, 2) for n in (1, 2)]
    spark.createDataFrame(items, "l_orderkey bigint, l_linenumber bigint, l_suppkey bigint, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.doc for r in integrity.vote_row_issues(spark, str(tmp_path)).where("code like 'vote_row%'").collect()} == {7}


def test_texts_of_a_small_file_are_dealt_over_tasks(spark):
    sf = "/root/testdata/sf0.001"
    for made in (documents.protocols, records_plan.papers, records_plan.paragraph_documents, search.dated_text, search.references_text):
        assert made(spark, sf).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_parts_are_judged_within_rows(spark):
    rows = [(1, p, 4, 0, sig, s, d) for p, sig, s, d in ((1, "a", [1, 2], []), (2, "a", [5], []), (3, "", [2, 3], [9, 9]), (4, "b", [2, 1], None), (5, "c", [9, 4], []), (6, None, None, None), (7, "", [7], [9]))]
    parts = spark.createDataFrame(rows, "g bigint, part bigint, pages int, rank int, signature string, sections array<int>, declared array<int>")
    got = records.deduplicated_parts(parts, "g")
    assert {r.part: (r.kept, r.overlaps) for r in got.collect()} == {1: (True, []), 2: (False, []), 3: (True, [9]), 4: (False, []), 5: (True, []), 6: (True, []), 7: (False, [])}
    assert "Python" not in got._jdf.queryExecution().toString() and "Pandas" not in got._jdf.queryExecution().toString()


def test_hash_tables_of_keys_are_dealt_over_tasks(spark):
    most, df = 4 * spark.sparkContext.defaultParallelism, spark.range(1000).selectExpr("id % 7 as k", "id as v")
    assert windows.encode_ranges(df, "k", "v").rdd.getNumPartitions() >= most
    assert quality.repeated(df.union(df), ["k", "v"]).rdd.getNumPartitions() >= most
    assert quality.dangling(df, df.where("v > 9"), ["v"], "k").count() == 10


def test_dates_with_many_rows_of_a_matter(spark):
    """A row means the first of its matter and date, the first one itself the second; and a meeting's rows are asked by minima."""
    row = "id bigint, doc string, date string, body string, matter string, diary string, point string"
    base = [(i, f"D{i}", "2024-01-02", "KS", "m", "ks 1/2024" if i == 7 else None, str(i)) for i in range(3, 9)]
    rows = spark.createDataFrame([(*r, "5") for r in base], f"{row}, base string")
    refs = [(10 * r[0], "date", "2024-01-02", *r, None) for r in base] + [(99, "section", "5", 4, "D0", "2024-01-02", "KS", "m", "ks 1/2024", "4", None)]
    got = references.targets(spark.createDataFrame(refs, f"ref bigint, kind string, label string, {row}, url string"), rows, rows.select("id", "date", "body").limit(0))
    found = {r.ref: (r.target, r.pool) for r in got.collect()}
    assert found == {30: (4, "matter"), **{10 * i: (3, "matter") for i in range(4, 9)}, 99: (7, "meeting")}


def test_texts_go_to_workers_in_small_batches(spark):
    packs.small_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
