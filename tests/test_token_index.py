"""Searches of the written index equal scores of the texts themselves."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rostra.functions import text
from rostra.operators import token_index


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(9)
    words = ["skola", "skolan", "skolor", "förskola", "budget", "Budgeten", "detaljplan", "detaljplaner", "kvarter", "kvarteret", "x", "ab", "license", "licence", "sublicense", "ny", "plan"]
    made = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 120)))) for i in range(150)]
    return made + [(200, None), (201, "  "), (202, "skola"), (203, "detaljplan kvarter"), (204, "Detaljplan, KVARTER!"), (205, "a " * 90 + "ny skola"), (206, "ny skolan ny"), (207, "enny skola"), (208, "ny skola ny skola")]


@pytest.mark.parametrize("query", ["skola", "ny skola", "budget", "detaljplan kvarter", "x", "license", "licens plan", "skolorna", "ny", "a b", "", "zzzz", "x ab ny plan budget skola license", "ny ny", "Ny Skola!"])
def test_scores_equal_field_score(spark, rows, tmp_path_factory, query):
    df = spark.createDataFrame([(i, t, "en" if i % 2 else "fr") for i, t in rows], "doc int, text string, lang string")
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    token_index.write_index(df, "doc", "text", path, ["lang"])
    got = {r.doc: (r.lang, r.score) for r in token_index.search(spark, path, query, "doc", ["lang"]).collect()}
    want = {r.doc: (r.lang, r.s) for r in df.select("doc", "lang", text.field_score(F.col("text"), query).alias("s")).where("s > 0").collect()} if query else {}
    assert got == want


def test_no_text_is_read_and_facets_restrict(spark, rows, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, t, "en" if i % 2 else "fr") for i, t in rows], "doc int, text string, lang string")
    path = token_index.write_index(df, "doc", "text", f"file://{tmp_path}/i", ["lang"])
    found = token_index.search(spark, path, "license", "doc", ["lang"], F.col("lang") == "fr")
    assert {r.lang for r in found.collect()} == {"fr"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan and "EqualTo(lang,fr)" in plan and "In(token, " in plan  # facets and tokens reach the scan
    monkeypatch.setattr(token_index, "FEW_TOKENS", 0)  # too many to be a filter: joined
    assert {(r.doc, r.score) for r in token_index.search(spark, path, "license", "doc", ["lang"], F.col("lang") == "fr").collect()} == {(r.doc, r.score) for r in found.collect()}


def test_texts_of_one_file_are_dealt_over_tasks(spark, rows, tmp_path):
    """Each task sorts its own words by token; words are not shuffled, nor normalised more than once."""
    spark.createDataFrame([(i, t) for i, t in rows if i < 150], "doc int, text string").coalesce(1).write.parquet(f"{tmp_path}/texts")
    texts = spark.read.parquet(f"{tmp_path}/texts")
    path = token_index.write_index(texts, "doc", "text", f"file://{tmp_path}/i")
    assert len(list((tmp_path / "i" / "postings").glob("part-*"))) >= 4 * spark.sparkContext.defaultParallelism
    each = spark.read.parquet(f"{path}/postings").select("token", "id", F.input_file_name().alias("f"))
    assert each.groupBy("id").agg(F.count_distinct("f").alias("n")).where("n > 1").isEmpty()
    for part in (tmp_path / "i" / "postings").glob("part-*"):
        held = [r.token for r in spark.read.parquet(str(part)).coalesce(1).collect()]
        assert held == sorted(held)


@pytest.mark.parametrize("query", ["license", "ny skola", "detaljplan kvarter", "x ab ny plan budget skola license"])
@pytest.mark.parametrize("most", [0, 10**5])
def test_postings_are_not_shuffled_to_meet_matching_tokens(spark, rows, tmp_path, monkeypatch, query, most):
    df = spark.createDataFrame(rows, "doc int, text string")
    path = token_index.write_index(df, "doc", "text", f"file://{tmp_path}/i")
    monkeypatch.setattr(token_index, "FEW_TOKENS", 0)
    monkeypatch.setattr(token_index, "MANY_TOKENS", most)  # broadcast, or scored in the posting
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for an index of many tokens
    try:
        found = token_index.search(spark, path, query, "doc")
        got = {r.doc: r.score for r in found.collect()}
        held = token_index.matching_postings(spark.read.parquet(f"{path}/postings"), token_index.matching_tokens(spark, path, query.split()), query.split())
        plan = held._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert got == {r.doc: r.s for r in df.select("doc", text.field_score(F.col("text"), query).alias("s")).where("s > 0").collect()}
