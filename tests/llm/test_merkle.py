"""The Merkle manifest against brute force and SQL, and on odd input."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from rostra.llm import merkle

SF = "/root/testdata/sf0.001"
KIND = "doc_id bigint, source string, lang string, n_chars bigint, text string, g string, key string, leaf string, other int, part int, row int, number int"


def h(*nodes):
    return sha256("".join(nodes).encode()).hexdigest()


def tree(leaves, fanout):
    """(root, siblings of each leaf by level as (place, others))."""
    now, ways, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(now) > 1:
        runs = [now[i : i + fanout] for i in range(0, len(now), fanout)]
        for w, i in zip(ways, at):
            run = runs[i // fanout]
            w.append((i % fanout, run[: i % fanout] + run[i % fanout + 1 :]))
        at, now = [i // fanout for i in at], [h(*r) for r in runs]
    return now[0], ways


def naive(rows, fanout=2):
    enc = lambda r: h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, enc(r)))
    trees = {g: tree([enc(r) for r in groups[g]], fanout) for g in names}
    root, tops = tree([trees[g][0] for g in names], fanout) if names else (None, [])
    out = []
    for g, top in zip(names, tops):
        for r, way in zip(groups[g], trees[g][1]):
            whole = [*way, *top]
            now = enc(r)
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                now = enc((*r[:3], r[3] + 1, r[4]))
            for at, others in whole:
                now = h(*others[:at], now, *others[at:])
            out.append((r[0], enc(r), trees[g][0], root, h(*(x for _, o in whole for x in o)), now, now == root))
    return Counter(out)


def made(spark, rows, **more):
    df = spark.createDataFrame([(*r, "g", "k", "l", 1, 2, 3, 4) for r in rows], KIND)
    return Counter(tuple(r) for r in merkle.manifest(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, **more).collect())


def test_query_equals_brute_force_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = Counter(tuple(r) for r in merkle.op11_merkle(spark, SF).collect())
    assert got == naive(rows) and {r[-1] for r in got} == {True, False}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert Counter(con.execute(merkle.OP11_SQL).fetchall()) == got


ODD = [(None, None, None, None, None), (None, "s", None, 3, "ä🙂"), (0, "", "", 0, ""), (1, "s", "en", None, "x" * 300_000), (1, "s", "en", 2, "tie"), (1, "s", "en", 2, "tie"), (2**63 - 1, "s", "de", 2**63 - 1, "last"), (-5, "s", "Ä", -1, "-")]


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_odd_input_and_fanouts(spark, fanout):
    rows = ODD + [(i, "s", "en" if i % 3 else "fr", i, f"t{i}") for i in range(7, 60)]
    assert made(spark, rows, fanout=fanout) == naive(rows, fanout)


def test_small_tables(spark):
    assert made(spark, []) == Counter()
    for n in (1, 2, 3):
        assert made(spark, [(7 * i, "s", "en", 1, "t") for i in range(n)]) == naive([(7 * i, "s", "en", 1, "t") for i in range(n)])
    rows = [(i, "s", f"l{i}", 1, "t") for i in range(9)]  # a group for each row
    assert made(spark, rows) == naive(rows)


def test_many_rounds_of_merging(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RISE", 2)
    monkeypatch.setattr(merkle, "PART_LEAVES", 4)
    rows = [(i, "s", "en" if i < 150 else None, i, "t") for i in range(205)]
    assert made(spark, rows) == naive(rows)


@pytest.mark.parametrize("fanout", [2, 3])
def test_stacks_of_any_cut_merge_to_the_whole(fanout):
    for n in range(1, 40):
        leaves = [sha256(str(i).encode()).hexdigest().encode() for i in range(n)]
        root = tree([x.decode() for x in leaves], fanout)[0]
        for a in range(n):
            for b in range(a, n):
                joined = merkle.Range(n, fanout)
                for s, e in ((0, a), (a, b), (b, n)):
                    part = merkle.Range(n, fanout)
                    for i in range(s, e):
                        part.push(0, i, leaves[i])
                    for p in part.peaks:
                        joined.push(*p)
                assert len(joined.peaks) == 1 and joined.peaks[0][2].decode() == root
