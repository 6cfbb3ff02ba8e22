"""Hand-made cases of the civic-records operators, and their invariants."""

from __future__ import annotations

import base64
import gzip
import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from rostra.functions import keys, text
from rostra.operators import allocation, entities, extraction, facets, joins, meetings, quality, records, references, votes, windows
from rostra.sources import listings, packs, sinks
from rostra.streaming import arrivals


def one(spark, **columns):
    """The values of column expressions."""
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).head()
    return row.asDict() if len(columns) > 1 else row[0]


# text search


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_field_scores(spark):
    cases = [
        ("skola", "skola", 1000), ("Skolan byggs", "skola", 900), ("Ny skola i Åkerby", "skola", 777), ("Detaljplan för kvarteret", "detaljplaner kvarter", 500),
        ("Laddinfrastruktur", "laddinfrastrukturen", 345), ("Budget för skolor", "skolar", 325), ("park", "budget", 0), ("", "budget", 0), (None, "x", 0), ("x", "", 0),
    ]
    for value, query, score in cases:
        assert one(spark, s=text.field_score(F.lit(value).cast("string"), query)) == score, (value, query)


def test_normalized_text(spark):
    said = "Å-ÄÖ  É/ñ … Größe\tÇA va?"
    want = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in unicodedata.normalize("NFD", said.lower()) if not unicodedata.combining(c)).split())
    assert one(spark, s=text.normalize_text(F.lit(said))) == want == text.normalize_query(said)


def test_token_matches_follow_the_rules(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 13))) for _ in range(150)]
    df = spark.createDataFrame([(w,) for w in words], "t string")

    def matches(q, t):
        if q in t:
            return True
        if min(len(q), len(t)) < 4:
            return False
        if min(len(q), len(t)) >= 6 and q[: (n := 6 if min(len(q), len(t)) >= 10 else 5)] == t[:n]:
            return True
        most = 2 if len(q) >= 8 else 1
        return abs(len(q) - len(t)) <= most and (q[0] == t[0] or q[-1] == t[-1]) and edits(q, t) <= most

    for q in words[:25]:
        assert [r.m for r in df.select(text.token_matches(q, F.col("t")).alias("m")).collect()] == [matches(q, t) for t in words]


def test_matching_needs_every_token(spark):
    t = F.lit("Ny förskola vid parken")
    assert one(spark, a=text.text_matches(t, "forskolan park"), b=text.text_matches(t, "forskola budget"), c=text.text_matches(t, ""), d=text.text_matches(t, "a b"), e=text.text_matches(t, "ny for")) == {"a": True, "b": False, "c": True, "d": False, "e": True}
    assert one(spark, a=text.dropdown_score(F.lit("Park"), "park"), b=text.dropdown_score(F.lit("Parken"), "park"), c=text.dropdown_score(F.lit("Stora parken"), "park"), d=text.dropdown_score(F.lit("Lekparken"), "park"), e=text.dropdown_score(F.lit("Skola"), "park")) == {"a": 100000, "b": 89994, "c": 79894, "d": 69961, "e": 0}


# facets and votes


def test_facets(spark):
    df = spark.createDataFrame([(2014, "S", "2024-01-05"), (2010, "M", None), (2018, "S", "2024-03-01")], "y int, p string, d string").withColumn("d", F.col("d").cast("date"))
    assert df.where(facets.facet_predicate({"y": [2010, 2014]})).count() == 2
    assert df.where(facets.facet_predicate({"y": [2014], "p": ["M"]})).count() == 0
    assert df.where(facets.in_ranges(F.col("d"), [])).count() == 3 and df.where(facets.in_ranges(F.col("d"), [("2024-02-01", "2024-01-01")])).count() == 1
    assert facets.date_ranges([("b", "a"), ("a", "b"), ("a", "a")]) == [("a", "a"), ("a", "b")]
    assert {(r.facet, r.value, r.n) for r in facets.facet_values(spark.createDataFrame([("A", "x"), ("a", None), ("b", "")], "u string, v string"), ["u", "v"]).collect()} == {("u", "A", 2), ("u", "b", 1), ("v", "x", 1)}


def test_stated_counts_come_first(spark):
    row = spark.createDataFrame([(5, 2, 1, 0, 0, 1, 3, None, 0, None)], "named int, yes int, no int, abstain int, absent int, rounds int, stated_yes int, stated_no int, stated_abstain int, stated_absent int")
    got = votes.merge_stated(row).head()
    assert (got.yes, got.no, got.abstain, got.absent, got.voters) == (3, 1, 0, 0, 5)
    assert one(spark, a=votes.event_base(F.lit("vote_x_1:12")), b=votes.split_ids(F.lit(" a, ,b,"))) == {"a": "vote_x_1", "b": ["a", "b"]}


def test_conflicts_are_reconciled_only_with_equal_totals(spark):
    events = spark.createDataFrame([("e", 1, 2, 0, 0), ("f", 1, 1, 0, 0), ("g", 2, 0, 0, 0)], "event string, stated_yes int, stated_no int, stated_abstain int, stated_absent int")
    ballots = spark.createDataFrame([("e", "Ja")] * 2 + [("e", "Nej")] + [("f", "Ja")] * 2 + [("f", "Nej")] * 1, "event string, vote string")
    got = {r.event: r for r in votes.mark_conflicts(events, ballots).collect()}
    assert (got["e"].stated_yes, got["e"].stated_no, got["e"].reconciled) == (2, 1, True)
    assert (got["f"].stated_yes, got["f"].count_conflict, got["f"].reconciled) == (1, True, False) and not got["g"].count_conflict


def test_participants_by_ballot_position_or_attendance(spark):
    points = spark.createDataFrame([(i, "m1" if i < 3 else "m2") for i in range(1, 6)], "id int, meeting string")
    ballots = spark.createDataFrame([(1, "ann", "S", "Ja"), (2, "bo", "M", "Nej")], "id int, name string, party string, vote string")
    positions = spark.createDataFrame([(4, "ann", "S")], "id int, name string, party string")
    present = spark.createDataFrame([("m1", "ann", "S")], "meeting string, name string, party string")
    ids = lambda **k: sorted(r.id for r in votes.filtered_points(points, ballots, positions, present, **k).collect())
    assert ids() == [1, 2, 3, 4, 5] and ids(members=["ann"]) == [1, 2, 4] and ids(parties=["S"]) == [1, 4] and ids(members=["ann"], votes=["Ja"]) == [1] and ids(votes=["Nej"]) == [2]


# allocation


def naive_seats(weights, seats, method, first):
    from fractions import Fraction

    won = [0] * len(weights)
    for _ in range(seats):
        over = [Fraction(k + 1) if method == "dhondt" else Fraction(first) if k == 0 else Fraction(2 * k + 1) for k in won]
        won[max(range(len(weights)), key=lambda i: (weights[i] / over[i], -i))] += 1
    return won


@pytest.mark.parametrize(("method", "first"), [("dhondt", "1.2"), ("adjusted", "1.2"), ("adjusted", "1.4")])
def test_sets_of_quotients_equal_seat_by_seat(spark, method, first):
    rnd = random.Random(9)
    cases = {c: [rnd.randrange(1, 500) for _ in range(rnd.randrange(1, 8))] for c in range(30)} | {99: [365, 287, 171, 105, 72]}
    rows = [(c, f"p{i}", v, 17) for c, vs in cases.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "contest int, party string, votes bigint, seats int")
    got = {(r.contest, r.party): r.won for r in allocation.allocate(df, "contest", "party", "votes", "seats", method, first).collect()}
    for c, vs in cases.items():
        assert [got[c, f"p{i}"] for i in range(len(vs))] == naive_seats(vs, 17, method, first), vs
    assert [got[99, f"p{i}"] for i in range(5)] == [6, 5, 3, 2, 1]
    steps = allocation.seat_steps(df, "contest", "party", "votes", "seats", method, first)
    assert steps.groupBy("contest").count().where("count <> 17").count() == 0


def test_needed_votes_are_enough_and_no_fewer(spark):
    votes_of = [36, 20, 11, 7]
    df = spark.createDataFrame([(1, f"p{i}", v, 7) for i, v in enumerate(votes_of)], "contest int, party string, votes bigint, seats int")
    base = naive_seats(votes_of, 7, "dhondt", "1.2")
    for r in allocation.needed_votes(df, "contest", "party", "votes", "seats").collect():
        i = int(r.party[1:])
        more = lambda n, i=i: naive_seats([v + n * (k == i) for k, v in enumerate(votes_of)], 7, "dhondt", "1.2")[i]
        assert more(r.needed) > base[i] and more(r.needed - 2) == base[i]


def test_lots(spark):
    parties = [(f"p{i}", v) for i, v in enumerate([36, 7, 6, 5, 5, 4, 2])]
    won, steps = allocation.allocate_contest(parties, 17, "dhondt", "1.2", "123456789m")
    assert won == [11, 2, 1, 1, 1, 1, 0] and [(s, w) for s, w, lot in steps if lot] == [(7, "p0"), (10, "p4"), (13, "p5")]
    won, steps = allocation.allocate_contest(parties, 11, "dhondt", "1.2", "123456789e")
    assert won == [7, 1, 1, 1, 1, 0, 0] and [(s, w) for s, w, lot in steps if lot] == [(7, "p0"), (10, "p4")]
    draws = allocation.Draws("123456789m")
    assert draws.state == 7689394087655829356 and [draws.next() for _ in range(3)] == [0.333938, 0.868417, 0.798812]
    df = spark.createDataFrame([(1, p, v, 17, 11) for p, v in parties], "contest int, party string, votes bigint, members int, more int")
    both = allocation.members_and_substitutes(df, "contest", "party", "votes", "members", "more", "123456789")
    assert {r.party: (r.members, r.substitutes) for r in both.collect()} == dict(zip([p for p, _ in parties], zip([11, 2, 1, 1, 1, 1, 0], [7, 1, 1, 1, 1, 0, 0], strict=True), strict=True))


def test_large_first_divisor_needs_the_exact_way():
    won, _ = allocation.allocate_contest([("a", 100), ("b", 60), ("c", 5)], 5, "adjusted", "5", "1")
    assert won == naive_seats([100, 60, 5], 5, "adjusted", "5")


def test_largest_remainders(spark):
    df = spark.createDataFrame([(1, "a", 20), (1, "b", 30), (1, "c", 49), (2, "a", 1), (2, "b", 1), (2, "c", 1), (3, "a", 0), (3, "b", None)], "g int, i string, w int")
    got = {(r.g, r.i): r.units for r in allocation.largest_remainder(df, "g", "i", "w").collect()}
    assert [got[1, x] for x in "abc"] == [20202020, 30303030, 49494950] and [got[2, x] for x in "abc"] == [33333334, 33333333, 33333333] and got[3, "a"] == got[3, "b"] == 50000000


def test_counts_and_percents_agree(spark):
    counts, percents = [365, 287, 171, 105, 72], [36.5, 28.7, 17.1, 10.5, 7.2]
    for method in ("dhondt", "adjusted"):
        runs = []
        for values in (counts, [round(p * 10**6) for p in percents]):
            df = spark.createDataFrame([(1, f"p{i}", v, 17) for i, v in enumerate(values)], "contest int, party string, votes bigint, seats int")
            runs.append({r.party: r.won for r in allocation.allocate(df, "contest", "party", "votes", "seats", method).collect()})
        assert runs[0] == runs[1]


# scalars


def test_scalars(spark):
    assert one(spark, r=keys.expanded_ranges(F.lit("Paragraf 1–3, 5 och 7-8"))) == [1, 2, 3, 5, 7, 8]
    assert one(spark, r=keys.expanded_ranges(F.lit("9-7, 1–1002, 3"))) == [3]
    assert max(one(spark, r=keys.expanded_ranges(F.lit("1-999999999 och 99999999999")))) <= 9999
    assert one(spark, a=keys.result_group(F.lit("")), b=keys.result_group(F.lit("tabled")), c=keys.result_group(F.lit("refer_back")), d=keys.result_group(F.lit(None).cast("string"))) == {"a": "approved", "b": "continued", "c": "refer_back", "d": "approved"}
    assert one(spark, a=keys.swedish_date(F.lit("den 3 mars 2023"), F.lit(2024)), b=keys.swedish_date(F.lit("12 Oktober"), F.lit(2024)), c=keys.swedish_date(F.lit("i går"), F.lit(2024))) == {"a": "2023-03-03", "b": "2024-10-12", "c": None}
    assert one(spark, a=keys.composite_key(F.lit(None), F.lit("b")), b=keys.slug(F.lit(" Åre Ö 12!")), c=keys.preview(F.lit("abc def"), 4)) == {"a": "|b", "b": "are-o-12", "c": "abc…"}
    assert one(spark, a=keys.effective_result(F.lit("approve"), F.lit("motionen avslås")), b=keys.effective_result(F.lit("approve"), F.lit("Motionen Avslås")), c=keys.effective_result(F.lit(None), F.lit(""))) == {"a": "reject", "b": "approve", "c": "other"}
    assert one(spark, a=windows.numeric_key(F.lit("a10")) > windows.numeric_key(F.lit("a2")), b=windows.numeric_key(F.lit("B007x")) == windows.numeric_key(F.lit("b7x"))) == {"a": True, "b": True}
    low = sorted(("x9" * 1, "x10", "x" + "9" * 20, "x1" + "0" * 20, "x1a2", "x1a10", "y"), key=lambda t: one(spark, k=windows.numeric_key(F.lit(t))))
    assert low == ["x1a2", "x1a10", "x9", "x10", "x" + "9" * 20, "x1" + "0" * 20, "y"]
    assert one(spark, a=text.normalize_decision(F.lit("§ 51. Svar  på «Å/B» – 3+4?"))) == "51 svar pa «a b» 3+4"


# joins and windows


def test_runs_stand_in_other_documents(spark):
    rnd = random.Random(4)
    docs = {i: [rnd.choice("abc") for _ in range(rnd.randrange(1, 6))] for i in range(40)}
    df = spark.createDataFrame([(i, t, h) for i, d in docs.items() for t, h in enumerate(d)], "d int, t int, h string")
    want = {(a, b, k) for a, x in docs.items() for b, y in docs.items() for k in range(len(y) - len(x) + 1) if y[k : k + len(x)] == x}
    assert {tuple(r) for r in joins.runs_found(df, "d", "t", "h").collect()} == want


def test_range_join_takes_the_first_cover(spark):
    pages = spark.createDataFrame([("d", 1), ("d", 70), ("d", 200), ("e", 5)], "doc string, page int")
    ranges = spark.createDataFrame([("d", 9, 0, 100), ("d", 3, 60, 80), ("e", 1, 6, 9)], "doc string, rng int, b int, e int")
    assert {(r.doc, r.page): r.rng for r in joins.range_first(pages, ranges, "doc", "page", "b", "e", "rng").collect()} == {("d", 1): 9, ("d", 70): 3, ("d", 200): None, ("e", 5): None}


def test_ranges_round_trip(spark):
    ids = [(k, v) for k in "ab" for v in {1, 2, 3, 7, 9, 10}] + [("a", 3)]
    df = spark.createDataFrame(ids, "k string, v bigint")
    runs = windows.encode_ranges(df, "k", "v")
    assert {(r.k, r.begin, r.length) for r in runs.collect()} == {(k, b, n) for k in "ab" for b, n in ((1, 3), (7, 1), (9, 2))}
    assert {tuple(r) for r in windows.decode_ranges(runs, "k", "v").collect()} == set(ids)


def test_parts_number_rows_in_order(spark):
    df = spark.createDataFrame([(i * 37 % 1000, i) for i in range(1000)], "k int, i int").repartition(7)
    got = sinks.with_parts(df, ["k", "i"]).collect()
    assert [r.ordinal for r in sorted(got, key=lambda r: (r.k, r.i))] == list(range(1, 1001)) and all(r.part == (r.ordinal + 127) // 128 for r in got)


def test_byte_bounded_parts(spark):
    df = spark.createDataFrame([("g", i, 450 if i != 5 else 5000) for i in range(12)], "g string, i int, n int")
    got = sorted(sinks.byte_bounded_parts(df, "g", "i", "n", 1800).collect(), key=lambda r: r.i)
    sums: dict = {}
    for r in got:
        sums.setdefault(r.part, []).append(450 if r.i != 5 else 5000)
    assert len(sums) > 1 and all(sum(v) <= 1800 or len(v) == 1 for v in sums.values()) and [r.part for r in got] == sorted(r.part for r in got)


def test_byte_bounded_parts_equal_a_scan_and_hold_no_group(spark):
    rnd = random.Random(8)
    sizes = [0, 0, None, 1, 5, 90, 100, 101, 350, 30, 40]
    rows = [(g, i, rnd.choice(sizes)) for g, n in (("a", 300), ("b", 1), (None, 40), ("c", 60)) for i in range(n)] + [("z", i, 0) for i in range(5)] + [("y", i, 500) for i in range(4)]
    want = set()
    for g in {r[0] for r in rows}:
        part, held = 1, 0
        for _, i, n in sorted(r for r in rows if r[0] == g) if g else sorted((r for r in rows if r[0] is None), key=lambda r: r[1]):
            if held and held + (n or 0) > 100:
                part, held = part + 1, 0
            held += n or 0
            want.add((g, i, part))
    rnd.shuffle(rows)
    out = sinks.byte_bounded_parts(spark.createDataFrame(rows, "g string, i int, n int"), "g", "i", "n", 100)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(rows) and set(got) == want
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    assert sinks.byte_bounded_parts(spark.createDataFrame([], "g string, i int, n int"), "g", "i", "n", 100).count() == 0


def test_orphans_need_a_verified_full_name(spark):
    df = spark.createDataFrame([("m", "S", "Anna Berg", True), ("m", "S", "Berg", False), ("m", "M", "Berg", False), ("m", "S", "Ek", False), ("m", "S", "Bo Ek", False)], "meeting string, party string, name string, verified boolean")
    assert [tuple(r) for r in joins.orphan_fragments(df).collect()] == [("m", "S", "Berg")]


def test_aliases(spark):
    df = spark.createDataFrame([("S", "Anna Berg", 5), ("S", "Ana Berg", 1), ("S", "Bo Ek", 2), ("S", "Bo Ék", 2), ("M", "Anna Berk", 1)], "party string, name string, n int")
    assert {(r.party, r.alias, r.canonical) for r in entities.automatic_aliases(df, "party", "name", "n").collect()} == {("S", "Ana Berg", "Anna Berg"), ("S", "Bo Ek", "Bo Ék")}
    rnd = random.Random(3)
    names = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 6))) for _ in range(60)})
    pairs = entities.alias_pairs(spark.createDataFrame([("p", n) for n in names], "party string, name string"), "party", "name")
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for a in names for b in names if a < b and edits(a, b) <= 1}


def test_person_keys(spark):
    cases = {"Ærø Bech-Olsen": "aero bech olsen", "Jäv  Åsa Öberg": "asa oberg", "Ersätter Bo Ek": "", "ersättare för Bo": "", "Bo Ek, politisk sekreterare": "bo ek", "2024-01-02 Bo–Ek": "bo ek", "Frånvarandes Bo": "franvarandes bo"}
    assert {k: one(spark, x=entities.person_key(F.lit(k))) for k in cases} == cases and one(spark, x=entities.person_key(F.lit(None).cast("string"))) == ""


# extraction

PAGES = [
    ("u", 1, "Protokoll Ks 12/2024\nDatum: 2024-02-03\nBeslutande ledamöter:\nAnna Berg (S)\nBo Ek (M)\nErsättare\nCi Dahl (V)\nÖvriga närvarande\nEva Fors (X)\n1 (2)"),
    ("u", 2, "§ 10 Motion om skolan\nSs 3/2024\nAnna Berg (S) yrkar bifall till motionen.\nNämnden beslutar\n1. avslå\n2. utse\nen ny\n2 (2)"),
]


def test_protocol_pages(spark):
    pages = spark.createDataFrame(PAGES, "doc string, page int, text string")
    first = pages.where("page = 1")
    assert first.select(extraction.diary_from_first_page(F.col("text"))).head()[0] == "Ks 12/2024" and first.select(extraction.first_page_date(F.col("text"))).head()[0] == "2024-02-03"
    assert one(spark, d=extraction.diary_from_first_page(F.lit("Ks 1/2024 och\nSs 2/2024"))) == ""
    got = {(r.name, r.party, r.role) for r in extraction.attendance(pages, ["doc"], "page", "text", {"beslutande ledamöter": "member", "ersättare": "substitute"}).collect()}
    assert got == {("Anna Berg", "S", "member"), ("Bo Ek", "M", "member"), ("Ci Dahl", "V", "substitute")}
    s = extraction.sections(pages, "doc", "page", "text").collect()
    assert [(r.section, r.title, r.first_page, r.last_page, r.repeated) for r in s] == [("10", "Motion om skolan", 2, 2, False)]
    d = extraction.decision_points(spark.createDataFrame([("u", "10", "Nämnden beslutar\n1. avslå\n2. utse\nen ny"), ("v", "3", "Bara\ntext")], "doc string, s string, t string"), "doc", "s", "t")
    assert {(r.point, r.decision) for r in d.collect()} == {("10.1", "Nämnden beslutar avslå"), ("10.2", "Nämnden beslutar utse en ny"), ("3", "Bara text")}
    assert [(r.name, r.party, r.stance) for r in extraction.positions(pages, ["doc"], "text").collect()] == [("Anna Berg", "S", "Bifallsyrkande")]


def test_tallies(spark):
    got = one(spark, t=extraction.stated_tally(F.lit("Omröstning: Ja: 31, 28 nej-röster, frånvarande 2")))
    assert (got.yes, got.no, got.abstain, got.absent) == (31, 28, None, 2)
    assert one(spark, t=extraction.stated_tally(F.lit("Ja: 99999999999"))).yes is None
    assert one(spark, a=extraction.vote_held(F.lit("Votering begärs")), b=extraction.vote_held(F.lit("Ingen votering"))) == {"a": True, "b": False}


def test_blocks_and_repaired_meanings(spark):
    said = "Ett\ntvå\n\n- tre\nfyra\n2. fem\n\nsex"
    got = spark.createDataFrame([(said,), (None,)], "t string").select(extraction.text_blocks("t").alias("b")).collect()
    assert [(x.kind, x.text) for x in got[0].b] == [("paragraph", "Ett två"), ("item", "tre fyra"), ("item", "fem"), ("paragraph", "sex")] and got[1].b == []
    df = spark.createDataFrame([("JA-röst är bifall till", "X. JA-röst  är bifall till motionen. Slut"), ("kort", "kort och mer"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(extraction.repaired_meaning("a", "b")).collect()] == ["JA-röst är bifall till motionen.", "kort", None]


def test_references(spark):
    df = spark.createDataFrame([(1, "Se § 12.3, Ks 4/2023 och xKs 5/2023, 2024-01-02 samt 3 Mars.")], "id int, t string")
    assert [(r.label, r.kind) for r in references.extract(df, "id", "t").orderBy("pos").collect()] == [("§ 12.3", "section"), ("Ks 4/2023", "diary"), ("2024-01-02", "date"), ("3 Mars", "day")]


def naive_target(ref, rows, meetings):
    """One reference by the rules, row by row."""
    me = {**ref}
    if ref["kind"] == "date":
        held = [m["id"] for m in meetings if m["date"] == ref["label"] == ref["date"] and m["body"] == ref["body"]]
        if held and min(held) != ref["id"]:
            return min(held)
        same = [r["id"] for r in rows if r["date"] == ref["label"] and r["matter"] and r["matter"] == ref["matter"] and r["id"] != ref["id"]]
        return min(same, default=None)
    if ref["kind"] == "diary" and ref["diary"] == ref["label"]:
        return None
    pool = [r for r in rows if r["base" if ref["kind"] == "section" else "diary"] == ref["label"]]
    meeting = lambda r: r["date"] == me["date"] and r["body"] == me["body"]
    tiers = [lambda r: r["doc"] == me["doc"], meeting, *([lambda r: r["body"] == me["body"]] if ref["kind"] == "section" else []), lambda r: True]
    pool = next((p for t in tiers if (p := [r for r in pool if t(r)])), [])
    other, matter = (lambda r: r["id"] != me["id"]), (lambda r: r["matter"] and r["matter"] == me["matter"])
    diary = lambda r: r["diary"] and r["diary"] == me["diary"]
    for keep, order in (
        (lambda r: r["id"] == me["id"] and r["point"] == me["point"], ["id"]), (lambda r: diary(r) and r["doc"] == me["doc"], ["id"]), (lambda r: diary(r) and meeting(r), ["id"]), (diary, ["id"]),
        (lambda r: other(r) and matter(r) and r["date"] >= me["date"], ["date", "point", "id"]), (lambda r: other(r) and matter(r), ["date", "point", "id"]), (lambda r: other(r) and r["doc"] == me["doc"], ["point", "id"]), (other, ["id"]), (lambda r: True, ["id"]),
    ):
        if found := [r for r in pool if keep(r)]:
            best = min(found, key=lambda r: [r[c] for c in order])["id"]
            return best if best != me["id"] else None
    return None


def test_targets_equal_the_rules_row_by_row(spark):
    rnd = random.Random(5)
    rows = [{"id": i, "doc": f"d{rnd.randrange(12)}", "date": f"2024-01-0{rnd.randrange(1, 6)}", "body": rnd.choice("xy"), "matter": rnd.choice(["m1", "m2", "m3", None]), "diary": rnd.choice(["k1", "k2", "k3", None]), "base": str(rnd.randrange(4)), "point": str(rnd.randrange(3)), "url": rnd.choice(["u", None])} for i in range(60)]
    refs = []
    for r in rows:
        for kind, label in (("section", str(rnd.randrange(5))), ("diary", rnd.choice(["k1", "k2", "k3", "k4"])), ("date", f"2024-01-0{rnd.randrange(1, 6)}")):
            refs.append({"ref": len(refs), "kind": kind, "label": label, **{k: v for k, v in r.items() if k != "base"}})
    meetings = [{"id": 1000 + i, "date": f"2024-01-0{i}", "body": "x"} for i in (1, 2, 3)]
    row = "id long, doc string, date string, body string, matter string, diary string, "
    got = references.targets(
        spark.createDataFrame(refs, "ref long, kind string, label string, " + row + "point string, url string"), spark.createDataFrame([{k: v for k, v in r.items() if k != "url"} for r in rows], row + "base string, point string"),
        spark.createDataFrame(meetings, "id long, date string, body string"),
    )
    found = {r.ref: r for r in got.collect()}
    assert len(found) == len(refs)
    for r in refs:
        want = naive_target(r, rows, meetings)
        assert found[r["ref"]].target == want, r
        assert want is not None or found[r["ref"]].pool == ("source" if r["kind"] != "date" and r["url"] else "none")


def test_parts_are_kept_once(spark):
    rnd = random.Random(8)
    parts = [(f"g{rnd.randrange(9)}", i, rnd.randrange(4), rnd.randrange(2), rnd.choice(["", "s1", "s2", "s3"]), sorted({rnd.randrange(5) for _ in range(rnd.randrange(3))}), sorted({rnd.randrange(5) for _ in range(rnd.randrange(2))})) for i in range(70)]
    df = spark.createDataFrame(parts, "g string, part long, pages int, rank int, signature string, sections array<int>, declared array<int>")
    got = {r.part: r for r in records.deduplicated_parts(df, "g").collect()}
    for g in {p[0] for p in parts}:
        kept = []
        number = lambda p: p[6] or p[5]
        for p in sorted((p for p in parts if p[0] == g), key=lambda p: (number(p)[0] if number(p) else 10**6, -p[2], p[3], p[1])):
            gone = any((p[4] and p[4] == q[4]) or (p[5] and p[5] == q[5]) or (p[6] and p[6] == q[6]) for q in kept)
            shared = next((x for x in (sorted(set(number(p)) & set(number(q))) for q in kept) if x), [])
            assert got[p[1]].kept != gone and (gone or got[p[1]].overlaps == shared), p
            kept += [] if gone else [p]


def test_field_scores_through_tokens(spark):
    rnd = random.Random(6)
    words = ["skola", "skolan", "skolor", "sko", "budget", "budgeten", "parken", "laddinfrastruktur", "x"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(0, 5)))) for i in range(80)] + [(99, None)]
    df = spark.createDataFrame(rows, "k int, t string")
    for q in ("skola", "budget skolan", "sko", "", "laddinfrastrukturen parken x", "a b c d e f g skola"):
        want = {(r.k, r.s) for r in df.select("k", text.field_score(F.col("t"), q).alias("s")).where("s > 0").collect()}
        assert {(r.k, r.score) for r in text.scored(df, "k", "t", q).collect()} == (want if q else set()), q


# sources and sinks


def test_pack_in_parts(spark, tmp_path):
    def part(n, docs, rows):
        (tmp_path / f"pack-{n}.js").write_text("window.pack = " + json.dumps({"schema": "1", "d": docs, "r": rows, "pr": [], "mr": ["2024-01-01", "b", "t", "n", "p", "r"]}) + ";\n")

    part(1, [{"i": "a", "dt": "2024-01-01", "p": {"1": "x"}}], ["0", "1", "Ann", "S", "Ja", "e:1", "0", "1", "Bo", "M", "Nej", "e:2"])
    part(2, [{"i": "b", "dt": "2024-01-02", "p": {}}], [])
    pack = packs.read_pack(spark, [f"file://{tmp_path}/pack-{n}.js" for n in (2, 1)])
    assert [(r.part, r.i) for r in pack["documents"].orderBy("part").collect()] == [(1, "a"), (2, "b")]
    assert [(r.name, r.vote, r.ord) for r in pack["votes"].orderBy("ord").collect()] == [("Ann", "Ja", 0), ("Bo", "Nej", 1)] and pack["attendance"].count() == 2
    with pytest.raises(Exception, match="stride"):
        packs.unstrided(spark.createDataFrame([(["a"] * 7,)], "f array<string>"), [], F.col("f")).collect()


def test_codecs_and_ndjson(spark, tmp_path):
    coded = "gz:" + base64.b64encode(gzip.compress("hej å".encode())).decode()
    assert [r[0] for r in spark.createDataFrame([(coded,), ("bar",), (None,)], "t string").select(packs.gunzipped("t")).collect()] == ["hej å", "bar", None]
    with gzip.open(tmp_path / "index.ndjson.gz", "wt") as f:
        f.write('{"type":"meta","total":2,"meetings":1}\n{"id":"a","n":1}\n{"id":"b"}\n')
    meta, rows = packs.ndjson(spark, f"file://{tmp_path}/index.ndjson.gz", "struct<id:string,n:int>")
    assert meta.head().total == 2 and {(r.id, r.n) for r in rows.collect()} == {("a", 1), ("b", None)}
    sinks.write_ndjson(spark.createDataFrame([("a", ""), ("b", "x")], "id string, v string"), f"file://{tmp_path}/out")
    assert {tuple(sorted(json.loads(r.value).items())) for r in spark.read.text(f"file://{tmp_path}/out").collect()} == {(("id", "a"),), (("id", "b"), ("v", "x"))}
    few = packs.positional(spark.createDataFrame([(["x"],), (["y", "z"],)], "r array<string>"), "r", ["a", "b"])
    assert {tuple(r) for r in few.collect()} == {("x", None), ("y", "z")}


def test_listings(spark):
    html = "<h2>Ett</h2><A class=x HREF='/a.pdf#p'>Pro<b>tokoll</b>\n 1</A><a href=\"https://x.org/b\">B</a>"
    got = listings.anchors(spark.createDataFrame([(1, html), (2, None)], "k int, h string"), "k", "h").collect()
    assert [(r.href, r.label) for r in got] == [("/a.pdf#p", "Protokoll 1"), ("https://x.org/b", "B")]
    assert one(spark, a=listings.canonical_link(F.lit("/a.pdf#p"), "https://y.org/"), b=listings.canonical_link(F.lit("c/d"), "https://y.org"), c=listings.canonical_link(F.lit("https://x.org/b#q"), "z")) == {"a": "https://y.org/a.pdf", "b": "https://y.org/c/d", "c": "https://x.org/b"}
    names = ["2024-01-05 Nämnden.pdf", "2024-01-05.pdf", "Protokoll-x.PDF", "2024-01-05 kallelse.pdf", "protokoll med budget.pdf", "protokoll.html"]
    assert [one(spark, p=listings.is_protocol_pdf(F.lit(n), F.lit(None).cast("string"))) for n in names] == [True, False, True, False, True, False]
    assert one(spark, p=listings.is_protocol_pdf(F.lit("bilaga.pdf"), F.lit("Protokoll"))) and not one(spark, p=listings.is_protocol_pdf(F.lit("2024-01-05 x.pdf"), F.lit("Reglemente")))
    assert listings.balanced_object("x registerInitialState('c', {\"a\": \"}\\\" {\", \"b\": {}} ) y", "registerInitialState(") == "{\"a\": \"}\\\" {\", \"b\": {}}"
    assert listings.balanced_object("none", "m(") is None and listings.balanced_object("m({", "m(") is None
    items = spark.createDataFrame([(1, 5), (1, 20_000), (1, 50)], "k int, at int")
    heads = spark.createDataFrame([(1, 10, "A"), (1, 40, "B")], "k int, at int, l string")
    assert {r.at: r.l for r in listings.preceding_heading(items, heads, "k", "at", "l").collect()} == {5: None, 20_000: None, 50: "B"}


def test_publish_or_keep(spark, tmp_path):
    path = f"file://{tmp_path}/gold"
    assert sinks.publish(spark, spark.range(3), path, lambda df: df.count() == 3) and spark.read.parquet(path).count() == 3
    assert not sinks.publish(spark, spark.range(5), path, lambda df: False) and spark.read.parquet(path).count() == 3
    assert sinks.publish(spark, spark.range(5), path, lambda df: True) and spark.read.parquet(path).count() == 5
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["gold"]


def test_upsert_and_new_work(spark):
    old, new = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string"), spark.createDataFrame([("b", ""), ("c", "3"), ("a", "9")], "k string, v string")
    assert {tuple(r) for r in sinks.upserted(old, new, "k", ["v"]).collect()} == {("a", "9"), ("b", "2"), ("c", "3")}
    live, state = spark.createDataFrame([("a",), ("b",), ("c",)], "url string"), spark.createDataFrame([("a", "ok"), ("b", "needs_review")], "url string, status string")
    assert {r.url for r in arrivals.new_work(live, state).collect()} == {"b", "c"}


def test_merged_indexes_move(spark):
    docs, rows = spark.createDataFrame([(0, "x")], "doc_index int, i string"), spark.createDataFrame([(0, "ann")], "doc_index int, n string")
    d, r = arrivals.merged_pack(docs, docs, rows, rows)
    assert sorted(x.doc_index for x in d.collect()) == [0, 1] and sorted(x.doc_index for x in r.collect()) == [0, 1]


def test_repeated_batches_change_nothing(spark, tmp_path):
    df = spark.range(50).withColumn("v", F.col("id") % 7)
    best = arrivals.RunningTopK(f"file://{tmp_path}/top", [F.desc("v"), F.asc("id")], "id", 5)
    assert best.result(spark, df.schema).count() == 0
    for n, part in enumerate((df.where("id < 20"), df.where("id >= 20"), df.where("id < 20"))):
        best(part, n)
        arrivals.RunningTopK(best.path, best.order, "id", 5)(part, n)  # given again, after a restart
    assert [r.id for r in best.result(spark, df.schema).orderBy(F.desc("v"), "id").collect()] == [r.id for r in df.orderBy(F.desc("v"), "id").limit(5).collect()]


def test_keys_count_once_however_often_they_come(spark, tmp_path):
    df = spark.createDataFrame([(1, 9), (1, 9), (1, 8), (1, 9), (2, 8), (3, 7), (4, 1)], "id int, v int")
    best = arrivals.RunningTopK(f"file://{tmp_path}/top", [F.desc("v")], "id", 3)
    best(df, 7)
    assert {tuple(r) for r in best.result(spark, df.schema).collect()} == {(1, 9), (2, 8), (3, 7)}


# quality and meetings


def test_rules_and_gate(spark):
    df = spark.createDataFrame([(i, "" if i < 12 else "x") for i in range(20)], "k int, v string")
    rules = [quality.Rule("empty", "error", lambda: quality.missing(df, "k", ["v"])), quality.Rule("few", "info", lambda: df.where("k > 18").select(F.col("k").alias("key")))]
    found = quality.issues(rules)
    got = {r.category: (r.n, r.samples) for r in quality.counted(found).collect()}
    assert got == {"empty": (12, "0,1,10,11,2,3,4,5"), "few": (1, "19")} and tuple(quality.gate(found).head()) == (12, False)
    assert quality.gate(found.where("severity = 'info'")).head().passes


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([], "meeting string, matter int, point int, vote_ids array<string>")
    assert tuple(meetings.decision_summary(none).head()) == (0, 0, 0, 0, 0)


def test_roles_add_up(spark):
    rows = [("m", f"n{i}", "S", "member" if i < 56 else "substitute" if i < 73 else "other") for i in range(82)] + [("m", "n1", "S", "member")]
    got = meetings.attendance_by_role(spark.createDataFrame(rows, "meeting string, name string, party string, role string"), ["meeting"], F.col("role"))
    assert {r.role_group: r.n for r in got.collect()} == {"member": 56, "substitute": 17, "other": 9}


def test_helper_columns_clash_with_nothing(spark):
    """Tables whose columns have the names that operators would give to helpers of their own."""
    df = spark.createDataFrame([(i, "x", i % 3, "a", "b") for i in range(10)], "id int, _name string, b int, name string, place string")
    assert sorted((r.ordinal, r.b) for r in sinks.with_parts(df, ["id"], 4).collect()) == [(i + 1, i % 3) for i in range(10)]
    fixes = spark.createDataFrame([(3, "new")], "id int, name string")
    odd = df.withColumn("new_name", F.lit("y"))
    assert {(r.id, r.name, r.new_name) for r in joins.corrected(odd, fixes, "id", ["name"]).collect()} == {(i, "new" if i == 3 else "a", "y") for i in range(10)}
    assert sinks.upserted(df.select(F.col("id").alias("new_name"), "name"), fixes.select(F.col("id").alias("new_name"), "name"), "new_name", ["name"]).where("name = 'new'").count() == 1
    rank = df.select(F.col("b").alias("rank"), "name")
    assert {(r.rank, r.name) for r in windows.most_frequent(rank, "rank", "name").collect()} == {(0, "a"), (1, "a"), (2, "a")}
    people = spark.createDataFrame([("S", "Asa Ek", "k")], "party string, name string, by_key string")
    aliases = spark.createDataFrame([("S", "Åsa Ek", "Åsa Ek")], "party string, alias string, canonical string")
    assert [tuple(r) for r in entities.reviewed(people, aliases, "party", "name").collect()] == [("S", "Åsa Ek", "k")]
    pair = spark.createDataFrame([(1, "u", "v")], "id int, l_x string, x string")
    assert [r.field for r in quality.parity(pair, pair.withColumn("x", F.lit("w")), "id", ["l_x", "x"]).collect()] == ["x"]
