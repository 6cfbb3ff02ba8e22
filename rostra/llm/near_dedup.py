"""Operator 8: near-duplicate documents by MinHash."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostra.llm.common import map_texts, near_ids, table, written
from rostra.llm.components import connected_components

#: A-Z in lower case, white space to blanks.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b in b"\t\n\v\f\r" else b for b in range(256))
WORDS = 5
#: Minima, and rows of a band: 32 bands of 4. A pair of similarity 0.85 shares no band in one case of 10**10.
MINIMA, ROWS = 128, 4
#: Minima that must agree before full sets are compared: 8 standard deviations below what similarity 0.85 gives.
AGREE = 77
#: Members of a band's bucket that are paired directly; larger buckets go the exact way of ``crowded_links``.
SMALL = 16
#: Ids below this leave room for nodes above them.
ROOM = 1 << 62
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles. A word's hash is taken once and kept."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().translate(FOLD).split(b" ")
        words = [w for w in words if w]
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 250_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(WORDS, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = mix(out * ODD + h[k : len(h) - n + 1 + k])
        return np.unique(out)


def multipliers() -> tuple[np.ndarray, np.ndarray]:
    """Multiply-add hashes modulo 2**64, of which the upper half counts: a universal family."""
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, MINIMA, dtype=np.uint64)


def minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), 2**64 - 1, np.uint64)
    for s in range(0, len(x), 128):
        h = x[s : s + 128, None] * a
        h += b
        np.minimum(out, h.min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(-1, ROWS).astype(np.uint64)
    h = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h * ODD + rows[:, k])
    return h.astype(np.int64)


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, same, keys, sig): ``same`` names the set of shingles, ``keys`` are the bands, ``sig`` the minima."""

    def factory():
        shingler, (a, b) = Shingler(), multipliers()

        def work(texts):
            sizes, same, keys, sigs = [], [], [], []
            for text in texts:
                x = shingler.shingles(text)
                sizes.append(len(x))
                if not len(x):
                    for column in (same, keys, sigs):
                        column.append(None)
                    continue
                same.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                sig = minima(x, a, b)
                keys.append(band_keys(sig))
                sigs.append(sig.tobytes())
            return [sizes, pa.array(same, pa.binary()), keys, pa.array(sigs, pa.binary())]

        return work

    return map_texts(df, [id_col, text_col], {"id": "bigint", "n_shingles": "bigint", "same": "binary", "keys": "array<bigint>", "sig": "binary"}, factory)


def shingle_sets(df: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, s): the full sets of the classes (node, rep, same), with the node as id."""

    def factory():
        shingler = Shingler()

        def work(texts):
            sets = [shingler.shingles(t) for t in texts]
            return [pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()), [x.view(np.int64) for x in sets]]

        return work

    texts = df.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text"))
    # most texts are turned away where they are read; the others are shuffled
    some = near_ids(texts, classes, "rep").join(classes.select("rep", "node"), "rep")
    sets = map_texts(some, ["node", "text"], {"node": "bigint", "same": "binary", "s": "array<bigint>"}, factory)
    # an id can have other texts than its class's
    return sets.join(classes.select("node", "same"), ["node", "same"], "left_semi").dropDuplicates(["node", "same"]).select(F.col("node").alias("id"), "s")


@F.pandas_udf(T.BinaryType())
def text_class(texts):
    """What names a text's set of shingles; empty without words."""
    import pandas as pd

    shingler = Shingler()
    sets = [shingler.shingles(t) for t in texts]
    return pd.Series([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else b"" for x in sets], dtype=object)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", common.alias("c"), (F.size("sa") + F.size("sb") - common).alias("u")).where(F.col("c") * 100 >= F.col("u") * percent).select("a", "b")


@F.pandas_udf(T.IntegerType())
def agreeing(x, y):
    import pandas as pd

    if not len(x):
        return pd.Series([], dtype="int32")
    a, b = (np.frombuffer(b"".join(v), np.uint32).reshape(len(v), -1) for v in (x, y))
    return pd.Series((a == b).sum(axis=1).astype(np.int32))


def crowded_links(sets: DataFrame, percent: int) -> DataFrame:
    """All links that matter among the documents of crowded buckets, found exactly: (a, b).

    Sets are ordered from rare to common shingles; two similar sets share one among the first few, and only so far from
    the start that the rest can still suffice. For each such shingle all are compared with the member that has the
    most common shingles (in a group of edited copies, the one nearest to all), and only pairs not yet joined by that
    are compared with each other, the smaller set by those of its rarest shingles alone that no pair can lack, which are
    about half as many. So pages of one template that are not similar enough rarely meet. A group of copies gives rows in proportion to its size, and no link is lost:
    what is left out lies within one component already.
    """
    flat = sets.select("id", F.explode("s").alias("t"))
    # counts and hubs are tables of their own, so that a join on a shingle of very many documents can be split
    counts = written(flat.groupBy("t").agg(F.count("*").alias("n")))
    ordered = flat.join(counts, "t").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("r"))
    size = F.size("r")
    reach = size - F.ceil(size * percent / 100.0 - 1e-9).cast("int") + 1
    heads = ordered.select("id", size.alias("z"), F.aggregate("r", F.lit(0).cast("bigint"), lambda s, x: s + x["n"]).alias("w"), F.posexplode(F.slice("r", F.lit(1), reach)).alias("p", "x"))
    heads = written(heads.select("id", "z", "w", "p", F.col("x.t").alias("t"), F.col("x.n").alias("n")).where("n > 1").drop("n"))
    best = written(heads.groupBy("t").agg(F.max(F.struct("w", F.negative("id").alias("i"))).alias("m")).select("t", F.col("m.w").alias("mw"), F.negative(F.col("m.i")).alias("m")))
    stars = heads.join(best, "t").where("id <> m").select(F.col("id").alias("a"), F.col("m").alias("b"), "mw").distinct()
    stars = written(confirmed(stars.select("a", "b").distinct(), sets, percent).join(stars, ["a", "b"]).select("a", "b", "mw"))
    hub = stars.groupBy("a").agg(F.max(F.struct("mw", F.negative("b").alias("i"))).alias("h")).select(F.col("a").alias("id"), F.negative(F.col("h.i")).alias("h"))
    named = heads.join(hub, "id", "left").withColumn("h", F.coalesce("h", "id"))
    # the smaller set of a pair has this overlap at least, so one of its first shingles is among the other's
    first = F.col("z") - F.ceil(F.col("z") * (2.0 * percent) / (100.0 + percent) - 1e-9) + 1
    # joined already: both at one hub, or one is the other's hub
    x, y = named.where(F.col("p") < first).alias("x"), named.alias("y")
    near = (F.col("x.z") < F.col("y.z")) | ((F.col("x.z") == F.col("y.z")) & (F.col("x.id") < F.col("y.id")))
    need = F.ceil((F.col("x.z") + F.col("y.z")) * percent / (100.0 + percent) - 1e-9)
    room = 1 + F.least(F.col("x.z") - F.col("x.p"), F.col("y.z") - F.col("y.p")) - 1
    rest = (
        x.join(y, F.col("x.t") == F.col("y.t")).where(near & (F.col("x.h") != F.col("y.h")) & (F.col("x.z") * 100 >= F.col("y.z") * percent) & (room >= need))
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    )
    return stars.select("a", "b").union(confirmed(rest, sets, percent))


def linked_classes(named: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows; the classes (same, rep, node) of rows with the same set of shingles; links (a, b) between nodes.

    A class's node is its smallest id; where that is the smallest of several classes, the others have nodes above all ids, or,
    where ids leave no room there, numbers that no id has.
    """
    every = written(signatures(named, id_col, text_col))
    classes = written(every.where("n_shingles > 0").groupBy("same").agg(F.min("id").alias("rep")))
    twice = classes.groupBy("rep").agg(F.min("same").alias("_least"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    most = every.agg(F.max("id")).head()[0]
    above = most is None or most < ROOM
    own = F.col("_least").isNull() | (F.col("same") == F.col("_least"))
    seed, joined = 0, classes.join(twice, "rep", "left")
    while True:
        other = F.lit(most or 0) + 1 + F.monotonically_increasing_id() if above else F.xxhash64("same", F.lit(seed)).bitwiseAND(F.lit(2**63 - 1))
        classes = written(joined.select("same", "rep", F.when(own, F.col("rep")).otherwise(other).alias("node")))
        if above or not classes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").head(1):
            break
        seed += 1  # a number was taken
    reps = written(every.select("id", "same", "keys", "sig").join(classes, "same").where("id = rep").dropDuplicates(["same"]).select(F.col("node").alias("id"), "keys", "sig"))
    rows = reps.select("id", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(rows.join(shared, "key"))
    groups = members.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("g"))
    pairs = (
        groups.select(F.posexplode("g").alias("i", "a"), "g").select("a", F.explode(F.slice("g", F.col("i") + 2, F.greatest(F.size("g") - F.col("i") - 1, F.lit(0)))).alias("b")).distinct()
    )
    sigs = reps.select("id", "sig")
    likely = pairs.join(sigs.toDF("a", "sa"), "a").join(sigs.toDF("b", "sb"), "b").where(agreeing("sa", "sb") >= AGREE).select("a", "b")
    likely = written(likely)
    crowd = written(members.where(F.col("n") > SMALL).select("id").distinct())
    ids = likely.select(F.col("a").alias("node")).union(likely.select("b")).union(crowd).distinct()
    sets = written(shingle_sets(named, classes.join(ids, "node", "left_semi"), id_col, text_col))
    return every, classes, confirmed(likely, sets, percent).union(crowded_links(sets.join(crowd, "id", "left_semi"), percent))


def with_components(classes: DataFrame, links: DataFrame) -> DataFrame:
    parts = connected_components(links)
    return classes.join(parts, classes.node == parts.node, "left").select("same", "rep", classes.node, F.coalesce("component", classes.node).alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per input row with an id: id, ``n_shingles``, ``component_id`` (smallest id reachable), ``kept``.

    1. Documents with the same set of shingles are one class, its smallest id stands for it: copies cost one row each.
    2. 128 universal hash minima of each class, in 32 bands. Buckets of up to SMALL members give pairs; signatures
       sift them, full sets confirm them. Members of larger buckets go through ``crowded_links``.
    3. Components by large-star and small-star; classes get their members back.

    Documents without words are linked with nothing. Null text: the same. Very long text: taken whole. Rows that repeat an
    id with another text: the id is linked through each of its rows. Empty table: no rows. Other columns are not read.
    """
    every, classes, links = linked_classes(df.where(F.col(id_col).isNotNull()), id_col, text_col, percent)
    # rows that repeat an id tie its classes together
    ties = every.where("n_shingles > 0").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    tied = written(every.join(ties, "id", "left_semi").select("id", "same").distinct().join(classes, "same").select("id", "node"))
    tied = tied.join(tied.groupBy("id").agg(F.min("node").alias("low")), "id").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    found = with_components(classes, links.union(tied))
    if classes.where("node <> rep").head(1):  # nodes that are no ids
        low = found.join(found.where("node <> rep").select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.min("rep").alias("low"))
        found = found.join(low, "component", "left").withColumn("component", F.coalesce("low", "component"))
    found = found.select("same", "component")
    out = every.select("id", "n_shingles", "same").join(found, "same", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), (F.col("id") == component).alias("kept"))


def kept_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """(id, same, kept) of each row with an id: whether its own text, whatever other rows its id has, stands for its group."""
    every, classes, links = linked_classes(df.where(F.col(id_col).isNotNull()), id_col, text_col, percent)
    found = with_components(classes, links)
    # nodes above all ids hide smaller ones: groups that have such take the class with the smallest id
    odd = found.join(found.where("node <> rep").select("component").distinct(), "component", "left_semi")
    lead = odd.groupBy("component").agg(F.min(F.struct("rep", "node")).alias("_l")).select("component", F.col("_l.node").alias("_lead"))
    found = found.join(lead, "component", "left").withColumn("component", F.coalesce("_lead", "component")).drop("_lead")
    out = every.select("id", "same").join(found, "same", "left")
    kept = F.col("component").isNull() | ((F.col("node") == F.col("component")) & (F.col("id") == F.col("rep")))
    return out.select(F.col("id").alias(id_col), F.coalesce("same", F.lit(b"")).alias("same"), kept.alias("kept"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without id is linked with nothing; as in the SQL it has no shingles, component or verdict."""
    docs = table(spark, sf_dir, "documents")
    nothing = [F.lit(0).cast("bigint").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"), F.lit(None).cast("boolean").alias("kept")]
    return near_duplicates(docs).unionByName(docs.where("doc_id is null").select("doc_id", *nothing))


#: The same by counting the shingles that documents share, and spreading the smallest id along links.
OP8_SQL = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
z as (select doc_id, count(*) as z from s group by doc_id),
c as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from c join z za on za.doc_id = a join z zb on zb.doc_id = b where 100 * c >= 85 * (za.z + zb.z - c)),
e as (select a, b from l union select b, a from l),
r as (select a as id, a as c from e union select e.b, r.c from r join e on e.a = r.id where r.c < e.b),
m as (select id, min(c) as c from r group by id)
select d.doc_id, coalesce(z.z, 0) as n_shingles, coalesce(m.c, d.doc_id) as component_id, d.doc_id = coalesce(m.c, d.doc_id) as kept
from documents d left join z on z.doc_id = d.doc_id left join m on m.id = d.doc_id
"""
