"""Operator 5: exact top-k inner products with an impact-ordered index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostra.llm.common import in_batches, shared_dir, table, written

SCALE = 1024
#: Queries whose vectors are broadcast at a time: QUERIES * 8 bytes for each dimension.
QUERIES = 4_096
LIMIT = 1 << 62
#: Vectors of an index block.
BLOCK = 16_384
#: Share of the largest impact at which each round of segments ends.
LEVELS = (0.15, 0.07, 0.03, 0.0)
#: A round's survivors are few enough to be rescored when they are this share of a block.
FEW = 0.2


def shift_of(dims: int) -> int:
    return int(dims + 1).bit_length()


class ImpactIndex:
    """Postings of a block's components by dimension, each list ordered by value: a query's segments of descending impact
    are then the two ends of each list.

    Segments are processed from the largest quantised impact down; after all above an impact were processed, a vector's score is at most its sum so far plus that impact for each
    of its postings still out. Vectors for which this bound is below the k-th best exact score found are out for certain.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.most = int(np.abs(vectors).max(initial=0))
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy().astype(np.int32)
        self.values = np.take_along_axis(vectors.T, self.order, axis=1)

    def top(self, own: int, q: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the query's k best in this block (ties to the smaller id; the query's own id is none). Those below
        ``floor`` may be left out."""
        n, dims = self.vectors.shape
        mine = self.ids == own
        largest = int(np.abs(q).max(initial=0)) * self.most * dims  # no sum of impacts is beyond
        if n - mine.sum() <= 4 * k or not dims or largest >= 1 << (62 - shift_of(dims)):
            rows = np.flatnonzero(~mine)
        else:
            rows = self.members(q, k, mine, floor)
        if largest >= 1 << 62:  # beyond 64 bits on the way, perhaps; a score itself must fit
            exact = self.vectors[rows].astype(object) @ q.astype(object)
            if max((abs(x) for x in exact), default=0) >= 1 << 63:
                raise OverflowError(f"a score of query {own} is beyond 64 bits")
            scores = np.array(exact, np.int64)
        else:
            scores = self.vectors[rows] @ q
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]

    def members(self, q: np.ndarray, k: int, mine: np.ndarray, floor: int | None = None) -> np.ndarray:
        """Rows that can be among the k best, and not below ``floor``."""
        n, dims = self.vectors.shape
        shift = shift_of(dims)  # a sum stands above the number of its postings in one integer
        sums = np.zeros(n, np.int64)
        largest = int((np.abs(q) * np.maximum(np.abs(self.values[:, 0]), np.abs(self.values[:, -1]))).max())
        low, high = np.zeros(dims, np.int64), np.full(dims, n, np.int64)
        use = np.flatnonzero(q)
        idle = dims - len(use)
        for level in LEVELS:
            bar = int(largest * level)
            for d in use:
                # postings with |q_d * value| > bar, quantised to the component's unit
                edge = bar // abs(int(q[d]))
                a = max(low[d], np.searchsorted(self.values[d], -edge, "left"))
                b = min(high[d], np.searchsorted(self.values[d], edge, "right"))
                w = int(q[d]) << shift
                for s in (slice(low[d], a), slice(b, high[d])):
                    if s.stop > s.start:
                        sums[self.order[d, s]] += self.values[d, s] * w + 1
                low[d], high[d] = a, max(a, b)
            known = sums >> shift
            bound = known + (dims - idle - (sums & ((1 << shift) - 1))) * bar
            bound[mine] = np.iinfo(np.int64).min
            guess = np.argpartition(bound, n - 2 * k)[n - 2 * k :]
            guess = guess[~mine[guess]]
            exact = np.sort(self.vectors[guess] @ q)
            if len(exact) < k:
                continue
            rows = np.flatnonzero(bound >= (exact[-k] if floor is None else max(int(exact[-k]), floor)))
            if len(rows) <= max(8 * k, FEW * n) or not bar:
                return rows
        return np.flatnonzero(~mine)


def vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): components as floor(scale * x); rows that hold none or non-finite ones are out."""
    fine = F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def stacked(column: pa.ListArray, dims: int) -> np.ndarray:
    """Lists as rows of a matrix, filled up with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    out = np.zeros((len(column), dims), np.int64)
    sizes = np.diff(np.concatenate([[0], ends]))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends - sizes, sizes)] = flat
    return out


def search(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products, ties to the smaller id.

    Queries come to the driver and the tasks in batches of QUERIES; each batch is one pass over the vectors, which stay where
    they are. A task indexes about BLOCK of its vectors at a time, asks all queries, and returns only its ``k`` best for each,
    so what is shuffled grows with rows and tasks, not with blocks; windows keep the best of those.

    Vectors null or with null or non-finite components take no part. Shorter vectors count as filled up with zeros. Rows
    that repeat id and vector count once; a query's own id is never found; an id with several vectors asks with the
    smallest. Ties: smaller id first. Empty tables: no rows. Other columns are not read. Components beyond 64 bits raise
    ValueError, scores beyond OverflowError.
    """
    spark = df.sparkSession
    every = written(vectors(df, id_col, vec_col, scale).distinct())
    asked = written(vectors(queries, id_col, vec_col, scale).groupBy("id").agg(F.min("v").alias("v")))
    n, wide, far = every.agg(F.count("*"), F.max(F.size("v")), F.max(F.exists("v", lambda x: (x >= LIMIT) | (x <= -LIMIT)))).head()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if far:
        raise ValueError(f"components of {vec_col} times {scale} must be within 2**62")
    path, kinds = shared_dir(spark), "query_id bigint, vec_id bigint, score bigint"
    spark.createDataFrame([], kinds).write.parquet(path)
    for batch in in_batches(asked, QUERIES):
        held = spark.sparkContext.broadcast((np.array([r.id for r in batch], np.int64), stacked(pa.array([r.v for r in batch], pa.list_(pa.int64())), max(wide, max(len(r.v) for r in batch)))))
        every.mapInArrow(lambda b, q=held: best_of(q.value, k, b), kinds).write.mode("append").parquet(path)
        held.unpersist()
    found = spark.read.schema(kinds).parquet(path)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of(asked: tuple[np.ndarray, np.ndarray], k: int, batches):
    """A task's ``k`` best vectors for each query."""
    owners, queries = asked
    none = np.zeros(0, np.int64)
    best = [(none, none)] * len(owners)

    def ask(ids, rows):
        index = ImpactIndex(np.concatenate(ids), np.concatenate(rows))
        for i, q in enumerate(queries):
            kept = best[i]
            new = index.top(int(owners[i]), q, k, int(kept[1][-1]) if len(kept[1]) == k else None)
            x, y = (np.concatenate(c) for c in zip(kept, new))
            at = np.lexsort((x, -y))[:k]
            best[i] = x[at], y[at]

    ids, rows, n = [], [], 0
    for whole in batches:
        for s in range(0, whole.num_rows, BLOCK):
            part = whole.slice(s, BLOCK)
            ids.append(part.column(0).to_numpy(zero_copy_only=False))
            rows.append(stacked(part.column(1), queries.shape[1]))
            n += part.num_rows
            if n >= BLOCK:
                ask(ids, rows)
                ids, rows, n = [], [], 0
    if n:
        ask(ids, rows)
    sizes = [len(x) for x, _ in best]
    if sum(sizes):
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(owners, sizes)), *(pa.array(np.concatenate(c)) for c in zip(*best))], names=["query_id", "vec_id", "score"])


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 100 = 0"))


OP5_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
