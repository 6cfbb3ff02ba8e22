"""Document fingerprints against brute force, and on odd input."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

from rostra.llm import fingerprints as fp

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n", "one", "One TWO three four", "a b c d e", "ÄÖ Ñandú Ünïcode wörd two 🙂 three 日本語 x", "word " * 20_000, "x" * 50_000, "same words in here as there are", "same words in here as there are"]


def hashed(words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=h)
    return h - (1 << 64) if h >> 63 else h


def sketch(text, k=fp.K):
    fold = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = [x for x in re.split(r"[ \t-\r]+", fold) if x]
    return sorted({hashed(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())[:k]


def alike(a, b, k=fp.K):
    both = sorted({*a, *b})[:k]
    return len({*both} & {*a} & {*b}) / len(both) if both else 1.0


def naive(rows, k=fp.K):
    """Results of (id, text) rows, in order of id and hash."""
    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest((t or "").encode(), seed=42))
    places = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    out, counts = [], Counter((i, t or "") for i, t in rows)
    for at, (i, t) in enumerate(places):
        after = places[(at + 1) % len(places)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b = sketch(t, k), sketch(edited, k)
        text = lambda s: "".join(f"{x & (1 << 64) - 1:016x}" for x in s)
        out += [(i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), alike(a, b, k), alike(a, sketch(after, k), k))] * counts[i, t]
    return out


def got(df):
    return [tuple(r)[:7] for r in df.collect()]


def table_of(spark, rows):
    """With further columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, t, 1, "x", 2, True, [3], "k") for i, t in rows], "doc_id bigint, text string, n int, h string, bucket int, edge boolean, sketch array<int>, key string")


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(got(fp.op13_fingerprints(spark, SF))) == sorted(naive(rows))


@pytest.mark.parametrize("bucket", [1, 3, 2000])
def test_order_over_buckets_and_odd_input(spark, monkeypatch, bucket):
    monkeypatch.setattr(fp, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(fp, "DRAWN", 2)
    rows = [(i * 3 - 9, t) for i, t in enumerate(ODD)] + [(None, "no id here at all, really"), (None, None), (None, None), (7, "repeated id of one text"), (7, "repeated id of one text"), (7, "and of another"), (2**63 - 1, "last"), (-(2**63), "first of all the rows there are")]
    found = got(fp.fingerprints(table_of(spark, rows)))
    key = lambda r: tuple((x is not None, x or 0) if j == 0 else x for j, x in enumerate(r))
    assert sorted(found, key=key) == sorted(naive(rows), key=key)


def test_single_and_empty(spark):
    assert got(fp.fingerprints(table_of(spark, [(5, "ab cd")]))) == naive([(5, "ab cd")])
    assert fp.fingerprints(table_of(spark, [(5, "x")]).limit(0)).collect() == []


def test_equal_texts_have_equal_fingerprints(spark):
    text = " ".join(f"w{i % 700}" for i in range(3000))
    rows = fp.fingerprints(table_of(spark, [(i, text if i % 2 else f"w{i}") for i in range(10)])).collect()
    assert len({r.fingerprint for r in rows if r.doc_id % 2}) == 1


def test_parts_merge_to_the_whole(spark):
    rnd = random.Random(4)
    words = [f"w{rnd.randrange(5000)}" for _ in range(4000)]
    parts = [(c, " ".join(words[a : a + 504])) for a in range(0, 4000, 500) for c in (1, None)]  # pieces overlap by four words
    s = fp.sketches(spark.createDataFrame(parts, "doc_id bigint, text string"))
    whole = {r.doc_id: r for r in fp.merged(s, "doc_id").collect()}
    assert {k: r.sketch for k, r in whole.items()} == {k: sketch(" ".join(words)) for k in (1, None)}
    true = len({tuple(words[i : i + 5]) for i in range(3996)})
    assert abs(whole[1].n_shingles - true) < 0.3 * true


def test_estimates_are_near_the_truth(spark):
    rnd, rows = random.Random(7), []
    for i in range(60):
        base = [f"w{rnd.randrange(100_000)}" for _ in range(600)]
        cut = rnd.randrange(1, 600)
        rows.append((i, " ".join(base), " ".join(base[:cut])))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    both = fp.with_sketch(fp.with_sketch(df, "a", "x"), "b", "y").select("i", "a", "b", fp.resemblance("x", "y").alias("j"), fp.containment(fp.F.col("y"), fp.F.col("x")).alias("c"), fp.distinct_shingles(fp.F.col("x")).alias("n"), fp.as_text(fp.F.col("x")).alias("t"), "x")
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    off = [abs(r.j - len(sets(r.a) & sets(r.b)) / len(sets(r.a) | sets(r.b))) for r in both.collect()]
    assert max(off) < 0.2 and sum(off) / len(off) < 0.05
    for r in both.collect():
        assert r.c == 1.0 and abs(r.n - len(sets(r.a))) < 0.35 * len(sets(r.a))
    assert [r.s for r in both.select(fp.from_text(fp.F.col("t")).alias("s")).collect()] == [r.x for r in both.collect()]


def test_no_python_runs(spark):
    plan = fp.op13_fingerprints(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
