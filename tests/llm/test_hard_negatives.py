"""Hard negatives against brute force, and on odd input."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rostra.llm import hard_negatives as hn

SF = "/root/testdata/sf0.001"
KIND = "vec_id bigint, embedding array<double>, label int, id string, tag string, asks int, v string"


def naive(rows, every, scale=hn.SCALE, k=5, m=3):
    fine = lambda e: e is not None and all(x is not None and math.isfinite(x) for x in e)
    whole = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(math.floor(x * scale) for x in e)) for i, e, lab in rows if i is not None and lab is not None and fine(e)]
    whole = sorted(set(whole))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i in sorted({w[0] for w in whole if w[0] % every == 0}):
        _, label, v = next(w for w in whole if w[0] == i)
        pos = sorted((-dot(v, w[2]), w[0]) for w in whole if w[0] != i and w[1] == label)[:k]
        for s, p in pos:
            neg = sorted((-dot(v, w[2]), w[0]) for w in whole if w[0] != i and w[1] != label and -50 * s <= 100 * dot(v, w[2]) <= -95 * s)[:m]
            out += [(i, p, r + 1, n, -s, -t) for r, (t, n) in enumerate(neg)]
    return sorted(out)


def mined(spark, rows, every, **more):
    df = spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], KIND)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hn.mine(df, F.col("vec_id") % every == 0, label, **more).collect())


def vectors(n, seed=1, dims=12, labels=4):
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(size=(labels, dims))
    return [(i, (centre[i % labels] * 0.4 + rnd.normal(size=dims)).tolist(), i % labels) for i in range(n)]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = sorted(con.execute(hn.OP12_SQL).fetchall())
    assert sorted(tuple(r) for r in hn.op12_hard_negatives(spark, SF).collect()) == want and len(want) > 50


@pytest.mark.parametrize(("anchors", "block", "tile"), [(4096, 8192, 128), (7, 16, 3)])
def test_batches_blocks_and_tiles(spark, monkeypatch, anchors, block, tile):
    monkeypatch.setattr(hn, "ANCHORS", anchors)
    monkeypatch.setattr(hn, "TILE", tile)
    rows = vectors(300)
    want = naive(rows, 5)
    assert mined(spark, rows, 5) == want and len(want) > 100
    run = hn.positives_of((np.array([0]), np.array([0]), np.array([[1, 2]])), np.eye(2), 2)
    monkeypatch.setattr(hn, "BLOCK", block)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([0] * 40), pa.array([0] * 40), pa.array([[i % 7, 1] for i in range(40)])], names=list("abcd"))
    assert [x for b in run([batch]) for x in b.column(1).to_pylist()] == [6, 13]


def test_odd_input(spark):
    rows = vectors(60, 2) + [(None, [1.0] * 12, 1), (100, None, 1), (101, [1.0, None] * 6, 1), (102, [float("nan")] * 12, 1), (103, [float("inf")] * 12, 1), (104, [1.0] * 12, None), (105, [0.5] * 3, 2), (110, [], 2), (115, [0.0] * 12, 0)]
    rows += [rows[5], rows[5], (5, [0.25] * 12, 1), (17, rows[3][1], 1), (18, rows[3][1], 1), (19, rows[3][1], 0), (21, rows[3][1], 3), (6, rows[7][1], 3), (6, rows[8][1], 3)]
    assert mined(spark, rows, 5) == naive(rows, 5)
    ties = [(i, [1.0, 0.5], i % 2) for i in range(40)] + [(40 + i, [0.6, 0.5], i % 2) for i in range(40)]
    assert mined(spark, ties, 5) == naive(ties, 5)
    assert mined(spark, [(0, [1.0], 3)], 5) == [] and mined(spark, [(1, [1.0], 3)], 5) == []
    assert hn.mine(spark.createDataFrame([], KIND), F.lit(True), F.col("label")).count() == 0


def test_large_components(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.uniform(-1, 1) * 2.0**21 for _ in range(6)], i % 3) for i in range(60)]  # products near 2**60
    assert mined(spark, rows, 5) == naive(rows, 5)
    with pytest.raises(ValueError, match="within"):
        mined(spark, [(0, [2.0**60], 1), (1, [1.0], 1)], 5)


def test_bounds_never_lose_a_pair():
    rnd = np.random.default_rng(5)
    for _ in range(60):
        dims, size = int(rnd.integers(1, 20)), 10 ** int(rnd.integers(0, 9))
        a, b = rnd.integers(-size, size + 1, (20, dims)), rnd.integers(-size, size + 1, (50, dims))
        turn = hn.rotation(rnd.integers(-9, 9, (40, dims)))
        assert np.allclose(turn.T @ turn, np.eye(dims), atol=1e-12)
        exact = a @ b.T
        low, high = np.sort(rnd.choice(exact.ravel(), (2, 20)), axis=0)
        kept = {*zip(*(x.tolist() for x in hn.Rotated(a, turn).survivors(hn.Rotated(b, turn), low.astype(float), high.astype(float))))}
        assert {(i, j) for i in range(20) for j in range(50) if low[i] <= exact[i, j] <= high[i]} <= kept
