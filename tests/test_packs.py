"""Packs: what their rules find, how they are assembled, split and published, and who is meant in them."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rostra.operators import assembly, entities, pack_rules, records
from rostra.sources import packs, sinks

META = {"source_page": 3, "source_page_end": "4", "source_url": "https://a.example.org/x", "decision_point_id": "d1", "extraction_status": "formal_decision"}
DOC = {"i": "c1", "dt": "2024-02-03", "b": "KS", "doc": "2024-02-03 KS.pdf", "u": "https://a.example.org/x", "ht": "§ 12 Motion", "ad": "", "bd": "Bifall"}


def pack(spark, tmp_path, *docs):
    """Documents through the reader, so that the maps come as packs hold them."""
    path = tmp_path / "part-01.js"
    path.write_text("window.pack = " + json.dumps({"d": [DOC | d for d in docs]}, ensure_ascii=False) + ";\n", encoding="utf-8")
    return packs.documents(packs.assigned_json(spark, str(path), "window.pack", packs.PACK))


def codes(df):
    return sorted((r.doc, r.code, r.item) for r in df.collect())


def test_sound_packs_have_no_issues(spark, tmp_path):
    docs = pack(spark, tmp_path, {"p": {"12": "Bifall"}, "pm": {"12": META}, "v": {"12": "e1"}, "ve": {"e1": {"yes_meaning": "bifall", "no_meaning": "avslag", "stated_yes": 1}}})
    assert codes(pack_rules.point_issues(docs, "boilerplate")) == [] and codes(pack_rules.document_issues(docs, "2019-01-01", "example.org")) == []
    assert codes(pack_rules.point_issues(docs.limit(0), "x")) == []


def test_point_rules(spark, tmp_path):
    docs = pack(
        spark, tmp_path,
        {"p": {"12": " ", "12.1": "x", "13": "y"}, "pm": {"12": META, "13": META | {"source_page": "x", "decision_point_id": "d2"}, "14": META}},
        {"p": {"12": ""}, "pm": {"12": META | {"extraction_status": "decision_not_extracted", "source_page_end": 1, "source_url": "https://b"}}, "v": {"12.7": " e1 ,e2,", "15": ""}, "ve": {"e1": {"yes_meaning": "förslag från m.fl"}}},
        {"p": None, "pm": None, "v": None, "ve": None},
    )
    assert codes(pack_rules.point_issues(docs, "zz")) == [
        (0, "empty_decision_point", "12"), (0, "header_point_mismatch", "13"), (0, "invalid_source_page", "13"), (0, "missing_point_metadata", "12.1"), (0, "orphan_point_metadata", "14"),
        (1, "duplicate_decision_point_id", "12"), (1, "invalid_source_page_range", "12"), (1, "point_source_url_mismatch", "12"), (1, "truncated_vote_meaning", "e1|yes_meaning"), (1, "vote_map_missing_event", "12.7|e2"), (1, "vote_map_missing_point", "15"),
    ]


def test_document_rules(spark, tmp_path):
    docs = pack(spark, tmp_path, {}, {}, {"i": "", "dt": "2018-01-01", "u": "http://example.org"}, {"i": "c4", "dt": None, "u": "https://notexample.org", "doc": "2024-05-05 x"}, {"i": "c5", "u": None, "doc": "p"})
    assert codes(pack_rules.document_issues(docs, "2019-01-01", "example.org")) == [
        (1, "duplicate_document_id", "c1"), (2, "document_before_public_cutoff", ""), (2, "document_title_date_mismatch", ""), (2, "missing_document_id", ""), (2, "non_official_source_url", ""),
        (3, "document_title_date_mismatch", "c4"), (3, "invalid_document_date", "c4"), (3, "non_official_source_url", "c4"), (4, "invalid_source_url", "c5"),
    ]


def test_votes_are_compared_vote_by_vote(spark, tmp_path):
    docs = pack(spark, tmp_path, {"p": {"1": "x"}, "ve": {"e:1": {"stated_yes": 1}, "k": {"stated_no": 0, "count_conflict": True, "source_stated_no": 5}}})
    rows = [(1, 0, "1", "Ja", "e:1:1"), (2, 0, "1", "Frånvarande", "e:1:2"), (3, 0, "1", "Frånvarande", "e:1:3"), (4, 0, "1", "Nej", "k:1"), (5, 0, "2", "Nja", "?"), (6, 9, "1", "Ja", "e:1:4")]
    votes = spark.createDataFrame([(r, d, p, "Åsa Ek", "S", v, e) for r, d, p, v, e in rows], "row bigint, doc bigint, point string, name string, party string, vote string, participant string")
    assert codes(pack_rules.vote_issues(docs, votes)) == [(0, "vote_row_invalid_value", "5"), (0, "vote_row_missing_event", "5"), (0, "vote_row_missing_point", "5"), (9, "vote_row_invalid_document", "6")]
    assert codes(pack_rules.vote_issues(docs, votes.unionByName(votes.where("row = 1").withColumn("row", F.lit(7)))))[0] == (0, "named_votes_exceed_protocol_total", "1|e:1|Ja")
    assert [(r.event, r.named_no, r.stated_no) for r in pack_rules.vote_conflicts(docs, votes).collect()] == [("k", 1, 5)]
    there = spark.createDataFrame([(1, "2024-02-03", "KS", "2024-02-03 KS.pdf", "ASA  ek", "s"), (2, "2024-02-04", "KS", None, "X", "S")], "row bigint, date string, body string, title string, name string, party string")
    assert [(r.code, r.item) for r in pack_rules.attendance_issues(docs, votes.where("doc = 0"), there).collect()] == [("attendance_row_unmatched_protocol", "2")]
    left = pack_rules.attendance_issues(docs, votes.where("doc = 0"), there.limit(0)).collect()
    assert sorted(r.item for r in left) == ["1", "4", "5"]  # absent members are not asked for


SAID = (
    "Beslutspunkt 2. Votering begärs och verkställs. Ja-röst innebär motionen. Nej-röst innebär avslag. Ja-röster lämnas av Anna Berg (S) och Bo Ek (M). Nej-röster lämnas av Ci Dahl (V).\n"
    "Ordföranden finner resultatet 2 ja-röster och 1 nej-röster. Beslutspunkt 1. Votering begärdes och verkställdes Ja-röst innebär bifall. Nej-röst innebär avslag. Ja-röster lämnas av A B (S). Nej-röster lämnas av C D (M). Resultatet 1 ja-röster och 2 nej-röster."
)


def test_votes_in_running_text(spark):
    two, none = {"7.1": "x", "7.2": "y"}, {}
    rows = [(1, "c 1", SAID, two, none), (2, "c", SAID, two, {"7.2": "e"}), (3, "c", SAID, {"7": "x"}, None), (4, "c", None, two, none), (5, "c", SAID.replace("begärs", "begärdes"), two, none), (6, "c", SAID, {"8.1": "x", "9.5": "x"}, none)]
    docs = spark.createDataFrame(rows, "doc int, name string, text string, p map<string,string>, v map<string,string>")
    votes = records.paragraph_votes(docs, "doc", "name", "text", "p", "v")
    assert sorted((r.doc, r.point, r.event, r.yes_meaning, r.no_meaning, r.yes, r.no) for r in votes.collect()) == [
        (1, "7.2", "vote_c_1_7_2_inferred_1", "bifall till motionen", "avslag", 2, 1), (3, "7", "vote_c_7_inferred_1", "bifall till motionen", "avslag", 2, 1),
    ]
    assert sorted((r.name, r.party, r.vote, r.participant[-5:]) for r in records.paragraph_ballots(votes, "doc").where("doc = 1").collect()) == [("Anna Berg", "S", "Ja", "yes_1"), ("Bo Ek", "M", "Ja", "yes_2"), ("Ci Dahl", "V", "Nej", ":no_1")]


def test_a_points_own_line(spark):
    text = "Beslut\r\n1. Ett\n 2.Två\nfortsätter\nJäv\nEj med\n3. Tre"
    got = spark.createDataFrame([("7.1",), ("7.2",), ("7.3",), ("7.4",), ("7",), (None,), ("7.x",)], "p string").select(records.final_line(F.lit(text), F.col("p")).alias("l")).collect()
    assert [r.l for r in got] == ["Ett 2.Två fortsätter", "Två fortsätter", "Tre", "", "", "", ""]


def test_section_points(spark):
    cases = {"": [("5", "")], "Bifall\n till": [("5", "Bifall till")], "Att\n1. a\nb\n2.c\n1. d": [("5.2", "Att c"), ("5.1", "Att d")], None: [("5", "")]}
    for text, want in cases.items():
        got = spark.range(1).select(assembly.section_points(F.lit("5"), F.lit(text).cast("string")).alias("x")).head().x
        assert [tuple(p) for p in got] == want


def test_a_pack_with_an_issue_leaves_the_published_one(spark, tmp_path):
    path, made = f"file://{tmp_path}/pack", spark.createDataFrame([(1,)], "i int")
    issues = spark.createDataFrame([("c", "error", "k")], "category string, severity string, key string")
    assert not assembly.publish_if_clean(spark, made, issues, path)
    assert assembly.publish_if_clean(spark, made, issues.limit(0), path)
    assert not assembly.publish_if_clean(spark, made.union(made), issues, path) and spark.read.parquet(path).count() == 1
    assert assembly.publish_if_clean(spark, made.union(made), issues.withColumn("severity", F.lit("info")), path) and spark.read.parquet(path).count() == 2


def test_pack_parts(spark):
    weights = spark.createDataFrame([(i, 40) for i in range(10)], "doc bigint, bytes bigint")
    assert {r.doc: r.part for r in sinks.pack_parts(weights, "doc", 100).collect()} == {i: i // 2 + 1 for i in range(10)}
    with pytest.raises(ValueError, match="document 3 needs 41 bytes"):
        sinks.pack_parts(weights.withColumn("bytes", F.when(F.col("doc") == 3, 41).otherwise(40)), "doc", 40)
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc bigint, m string")
    there = spark.createDataFrame([("a", "x"), ("a", "y"), ("z", "loose"), (None, "null")], "m string, n string")
    got = {r.doc: r.bytes for r in sinks.pack_weights(docs, "doc", ["m"], [docs.where("doc = 3"), docs.withColumn("doc", F.lit(9))], there, header=100).collect()}
    size = lambda x: len(json.dumps(x, separators=(",", ":"))) + 1
    own = size({"doc": 1, "m": "a"})
    assert got == {1: own + 100 + 2 * size({"m": "a", "n": "x"}) + size({"m": "z", "n": "loose"}) + size({"n": "null"}), 2: own, 3: 2 * own}


def test_whom_a_name_means(spark):
    rows = [("S", "KS", "Anna Berg"), ("S", "KS", "Anna Maria Berg"), ("S", "KS", "Berg"), ("S", "BN", "Berg"), ("S", "BN", "Bo Berg"), ("S", "SN", "Berg"), ("M", "KS", "Ek"), ("M", "BN", "Ci Ek"), ("V", "KS", "Ek"), ("V", "KS", None), (None, "KS", "Di Ås")]
    people = spark.createDataFrame(rows, "party string, body string, name string")
    by_body, by_party = entities.resolved_people(people, "party", "body", "name")
    got = {(r.party, r.body, r.norm): (r.name, r.how) for r in by_body.collect()}
    assert got[("S", "KS", "anna berg")] == ("Anna Maria Berg", "identity") and got[("S", "KS", "berg")] == ("Anna Maria Berg", "body") and got[("S", "BN", "berg")] == ("Bo Berg", "body")
    assert got[("S", "SN", "berg")] == ("Berg", "own") and got[("M", "KS", "ek")] == ("Ci Ek", "party") and got[("V", "KS", "ek")] == ("Ek", "own") and got[("", "KS", "di as")] == ("Di Ås", "identity")
    assert {(r.party, r.norm): r.name for r in by_party.collect()}[("S", "berg")] == ""
