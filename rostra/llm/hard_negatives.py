"""Operator 12: hard negatives by inner products, with partial sums over an orthogonal PCA rotation."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostra.llm.common import in_batches, shared_dir, table, unused, written
from rostra.llm.topk import LIMIT, stacked

SCALE = 256
#: Vectors, those of the smallest hashes, on which the rotation is fitted. Any rotation gives the same results.
FITTED = 4_096
#: Anchors whose vectors are broadcast at a time; bytes are at most ANCHORS * (8 * dimensions + 8 * fields).
ANCHORS = 4_096
#: Rows that a task scores at a time, and anchors in one product.
BLOCK, TILE = 8_192, 128
#: Shares of the components after which pairs are ruled out; below FEW survivors they are verified.
STEPS, FEW = (0.25, 0.5, 0.75, 1.0), 0.05


def rotation(vectors: np.ndarray) -> np.ndarray:
    """Orthogonal directions by descending sum of squared products with the vectors."""
    x = vectors.astype(np.float64)
    x /= max(1.0, np.abs(x).max(initial=0))
    return np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()


class Rotated:
    """Vectors in rotated form with what bounds any product: norms of what is left after each step, and slack for rounding."""

    def __init__(self, exact: np.ndarray, turn: np.ndarray):
        dims = exact.shape[1]
        self.exact = exact
        x = exact.astype(np.float64)
        self.x = x @ turn
        self.cuts = sorted({max(1, int(dims * s)) for s in STEPS}) if dims else []
        self.norm = np.sqrt((x * x).sum(1))
        self.left = [np.sqrt((self.x[:, c:] ** 2).sum(1)) for c in self.cuts]
        #: Rotating and adding in floating point is off by less than this part of the product of norms, with room to spare.
        self.part = 16 * (dims + 4) ** 1.5 * np.finfo(np.float64).eps

    def take(self, rows) -> Rotated:
        """Some rows."""
        out = object.__new__(Rotated)
        out.exact, out.x, out.norm, out.left, out.cuts, out.part = self.exact[rows], self.x[rows], self.norm[rows], [v[rows] for v in self.left], self.cuts, self.part
        return out

    def survivors(self, other: Rotated, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (own row, other's row) whose product can lie from ``low`` to ``high`` of the own row."""
        slack = self.part * self.norm[:, None] * other.norm[None, :] + 1e-6
        low, high = low[:, None] - slack, high[:, None] + slack
        sums, start = np.zeros(slack.shape), 0
        alive = np.ones(slack.shape, bool)
        for k, cut in enumerate(self.cuts):
            sums += self.x[:, start:cut] @ other.x[:, start:cut].T
            rest = self.left[k][:, None] * other.left[k][None, :]
            alive = (sums + rest >= low) & (sums - rest <= high)
            start = cut
            if np.count_nonzero(alive) <= FEW * alive.size:
                break
        return np.nonzero(alive)

    def products(self, own: np.ndarray, other: Rotated, rows: np.ndarray) -> np.ndarray:
        """Integer products of pairs."""
        dims = self.exact.shape[1]
        most = [int(np.abs(x.exact).max(initial=0)) for x in (self, other)]
        if most[0] * most[1] * max(1, dims) < 1 << 62:
            out, step = np.empty(len(own), np.int64), max(1, (1 << 21) // max(1, dims))
            for i in range(0, len(own), step):
                out[i : i + step] = np.einsum("ij,ij->i", self.exact[own[i : i + step]], other.exact[rows[i : i + step]])
            return out
        exact = [int(a.astype(object) @ b.astype(object)) for a, b in zip(self.exact[own], other.exact[rows])]
        if max(map(abs, exact), default=0) >= 1 << 63:
            raise OverflowError("a score is beyond 64 bits")
        return np.array(exact, np.int64)


def prepared(df: DataFrame, id_col: str, vec_col: str, label: F.Column, scale: int) -> DataFrame:
    """(id, label, tag, v) of distinct rows, ``tag`` a hash of label and vector, with a whole, finite vector, an id and a label."""
    fine = F.col(f"`{vec_col}`").isNotNull() & F.forall(f"`{vec_col}`", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.when(fine, F.col(f"`{vec_col}`")).alias("x"))
    return rows.where("id is not null and label is not null and x is not null").select("id", "label", F.transform("x", lambda x: F.floor(x.cast("double") * scale)).alias("v")).distinct().select("id", "label", F.xxhash64("label", "v").alias("tag"), "v")


def matrix(rows, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), np.int64)
    for at, v in zip(out, rows):
        at[: len(v)] = v
    return out


def blocks(batches, dims: int, turn: np.ndarray):
    """(ids, labels, tags, Rotated) of about BLOCK rows at a time."""
    held, n = [], 0

    def made():
        *numbers, exact = (np.concatenate(x) for x in zip(*held))
        return *numbers, Rotated(exact, turn)

    for b in batches:
        for s in range(0, b.num_rows, BLOCK):
            part = b.slice(s, BLOCK)
            held.append((*(part.column(i).to_numpy(zero_copy_only=False) for i in range(3)), stacked(part.column(3), dims)))
            n += part.num_rows
            if n >= BLOCK:
                yield made()
                held, n = [], 0
    if held:
        yield made()


def best(scores: np.ndarray, k: int, *ties: np.ndarray) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller of the first of ``ties``, then of the next."""
    some = np.arange(len(scores))
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return some[np.lexsort((*(t[some] for t in reversed(ties)), -scores[some]))[:k]]


LEAST, MOST = -float(1 << 63), float(1 << 63)


NONE = np.zeros(0, np.int64)


def positives_of(asked, turn, k: int):
    """A task's function: the ``k`` best rows of the same label for each anchor."""
    ids, labels, exact = asked

    def run(batches):
        anchors, kept = Rotated(exact, turn), [(NONE, NONE, NONE)] * len(ids)
        low = np.full(len(ids), LEAST)
        for row_ids, row_labels, tags, rows in blocks(batches, exact.shape[1], turn):
            for label in np.intersect1d(row_labels, labels):
                same, theirs = np.flatnonzero(labels == label), np.flatnonzero(row_labels == label)
                part = rows.take(theirs)
                for s in range(0, len(same), TILE):
                    own = same[s : s + TILE]
                    tile = anchors.take(own)
                    a, b = tile.survivors(part, low[own], np.full(len(own), MOST))
                    fair = ids[own[a]] != row_ids[theirs[b]]
                    a, b = a[fair], b[fair]
                    for i, *new in grouped(a, tile.products(a, part, b), row_ids[theirs[b]], tags[theirs[b]]):
                        every = [np.concatenate(x) for x in zip(kept[own[i]], new)]
                        at = best(every[0], k, *every[1:])
                        kept[own[i]] = tuple(x[at] for x in every)
                        if len(at) == k:
                            low[own[i]] = every[0][at[-1]]
        yield from found([(np.full(len(y), i), x, t, y) for i, (y, x, t) in zip(ids, kept)], ["anchor_id", "positive_id", "tag", "score"])

    return run


def negatives_of(asked, wanted, turn, k: int, least: int, most: int):
    """A task's function: for each anchor's positives, the ``k`` best rows of other labels from ``least`` to ``most`` hundredths of the positive's score."""
    ids, labels, exact = asked
    lows = [[-(-least * p // 100) for _, p in w] for w in wanted]  # rounded up
    highs = [[most * p // 100 for _, p in w] for w in wanted]

    def run(batches):
        anchors, kept = Rotated(exact, turn), [[(NONE, NONE)] * len(w) for w in wanted]
        bars = [list(x) for x in lows]
        low, high = np.array([min(x) for x in lows], np.float64), np.array([max(x) for x in highs], np.float64)
        for row_ids, row_labels, _, rows in blocks(batches, exact.shape[1], turn):
            for s in range(0, len(ids), TILE):
                own = np.arange(s, min(s + TILE, len(ids)))
                tile = anchors.take(own)
                a, b = tile.survivors(rows, low[own], high[own])
                fair = (labels[own[a]] != row_labels[b]) & (ids[own[a]] != row_ids[b])
                a, b = a[fair], b[fair]
                for i, y, x in grouped(a, tile.products(a, rows, b), row_ids[b]):
                    at = own[i]
                    order = np.lexsort((x, -y))
                    y, x = y[order], x[order]
                    for j, (lo, hi) in enumerate(zip(lows[at], highs[at])):
                        begin, end = np.searchsorted(-y, -hi, "left"), np.searchsorted(-y, -lo, "right")
                        if begin < (end := min(end, begin + k)):
                            every = [np.concatenate(c) for c in zip(kept[at][j], (y[begin:end], x[begin:end]))]
                            top = best(every[0], k, every[1])
                            kept[at][j] = tuple(c[top] for c in every)
                            if len(top) == k:
                                bars[at][j] = max(bars[at][j], int(every[0][top[-1]]))
                    low[at] = min(bars[at])
        rows = [(np.full(len(x), i), np.full(len(x), j), x, y) for i, held in zip(ids, kept) for j, (y, x) in enumerate(held)]
        yield from found(rows, ["anchor_id", "nth", "negative_id", "score"])

    return run


def grouped(owners: np.ndarray, *columns: np.ndarray):
    """Columns of each owner; owners ascend."""
    if len(owners):
        edges = [0, *(np.flatnonzero(np.diff(owners)) + 1).tolist(), len(owners)]
        for a, b in zip(edges, edges[1:]):
            yield (int(owners[a]), *(c[a:b] for c in columns))


def found(rows: list, names: list[str]):
    rows = [r for r in rows if len(r[-1])]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*rows)], names=names)


def mine(
    df: DataFrame, anchors: F.Column, label: F.Column, id_col: str = "vec_id", vec_col: str = "embedding", positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor's positives.

    ``anchors``: which rows ask; ``label``: the rows' labels. Scores are inner products of floor(scale * component). An
    anchor's positives are its ``positives`` best rows of its label; each one's negatives are the ``negatives`` best rows of
    other labels that score ``least`` to ``most`` hundredths of it. Ties go to the smaller id.

    Vectors are turned into directions by descending energy. Sums over leading components, what norms leave open, and slack
    for rounding bound each score; pairs that a bound rules out against the best ones known go early, and the others are
    verified by integer products, so results are exact.

    Anchors come to the driver and the tasks in batches of ANCHORS; each batch is two passes over the rows, which are not
    shuffled for it. A task returns its best few for each anchor, and windows keep the best of those.

    A null id, label or vector, or null or non-finite components: no part. Shorter vectors count as filled up with zeros. Rows
    that repeat id, label and vector count once; rows of an anchor's own id are never found; an anchor with several rows
    asks with the smallest. A positive id with several different rows may stand once for each. No positives or no fitting negatives: no
    rows. Empty table: no rows. Other columns are not read. Components beyond 2**62 raise ValueError, scores beyond 64 bits
    OverflowError.
    """
    spark = df.sparkSession
    name = unused(df, "asks")
    asking = df.withColumn(name, F.coalesce(anchors, F.lit(False)))
    rows = written(prepared(df, id_col, vec_col, label, scale))
    n, dims, far = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.exists("v", lambda x: (x >= LIMIT) | (x <= -LIMIT)))).head()
    kinds = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not n:
        return spark.createDataFrame([], kinds)
    if far:
        raise ValueError(f"components of {vec_col} times {scale} must be within 2**62")
    sample = rows.orderBy(F.xxhash64("id", "label", "v"), "id").limit(FITTED).collect()
    turn = spark.sparkContext.broadcast(rotation(matrix([r.v for r in sample], dims)))
    asked = written(prepared(asking.where(F.col(name)), id_col, vec_col, label, scale).groupBy("id").agg(F.min(F.struct("label", "v")).alias("s")).select("id", "s.label", "s.v"))
    path = shared_dir(spark)
    spark.createDataFrame([], kinds).write.parquet(path)
    for batch in in_batches(asked, ANCHORS):
        vectors = spark.sparkContext.broadcast((np.array([r.id for r in batch], np.int64), np.array([r.label for r in batch], np.int64), matrix([r.v for r in batch], dims)))
        first = rows.mapInArrow(lambda b, v=vectors: positives_of(v.value, turn.value, positives)(b), "anchor_id bigint, positive_id bigint, tag bigint, score bigint")
        order = W.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id", "tag")
        near = defaultdict(list)  # at most ANCHORS * positives
        for r in sorted(first.withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives).collect(), key=lambda r: r.r):
            near[r.anchor_id].append((r.positive_id, r.score))
        have = [i for i, r in enumerate(batch) if r.id in near]
        wanted = spark.sparkContext.broadcast((have, [near[batch[i].id] for i in have]))

        def second(batches, v=vectors, w=wanted):
            at, positive = w.value
            return negatives_of(tuple(x[at] for x in v.value), positive, turn.value, negatives, least, most)(batches)

        some = rows.mapInArrow(second, "anchor_id bigint, nth bigint, negative_id bigint, score bigint")
        order = W.partitionBy("anchor_id", "nth").orderBy(F.desc("score"), "negative_id")
        names = spark.createDataFrame([(a, n, i, p) for a, w in near.items() for n, (i, p) in enumerate(w)], "anchor_id bigint, nth bigint, positive_id bigint, positive_score bigint")
        ranked = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).join(F.broadcast(names), ["anchor_id", "nth"])
        ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
        vectors.unpersist()
        wanted.unpersist()
    return spark.read.schema(kinds).parquet(path)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(df, F.col("vec_id") % 50 == 0, label)


OP12_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
           where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
      from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as r from s where same),
n as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
             cast(row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as integer) as rank
      from p join s on p.anchor_id = s.anchor_id and not s.same and 100 * s.score between 50 * p.score and 95 * p.score where p.r <= 5)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
"""
