"""Operator 13: document fingerprints, bottom-k sketches of word-shingle hashes. DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostra.llm.common import near_ids, table, unused, without_ids, written

#: Hashes that a sketch keeps; a resemblance of r is estimated within about sqrt(r * (1 - r) / K).
K = 128
#: Words of a shingle.
WORDS = 5
#: Rows that a bucket of the order holds, about; at most MOST_BUCKETS * DRAWN keys of 16 bytes come to the driver.
BUCKET_ROWS, MOST_BUCKETS, DRAWN = 2_000, 65_536, 4

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def empty() -> Column:
    return F.array().cast("array<bigint>")


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words between white space of ASCII."""
    inner = F.trim(F.translate(text, UPPER, LOWER), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[ \t-\r]+"))


def shingle_hashes(words: Column, size: int = WORDS) -> Column:
    """A hash of each run of ``size`` words; of fewer words, but not none, one hash of all."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(n > 0, runs).otherwise(empty())


def lowest(hashes: Column, k: int = K) -> Column:
    """The ``k`` smallest of distinct hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, size: int = WORDS) -> DataFrame:
    """``df`` with the sketch of column ``text`` as ``name``; words are split once."""
    held = unused(df, "held")
    return df.withColumn(held, words_of(F.col(text))).withColumn(name, lowest(shingle_hashes(F.col(held), size), k)).drop(held)


def as_text(sketch: Column) -> Column:
    """The fingerprint: each hash as 16 hexadecimal digits."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def from_text(fingerprint: Column) -> Column:
    """The sketch of a fingerprint."""
    at = F.sequence(F.lit(0), (F.length(fingerprint) / 16).cast("int") - 1)
    half = lambda i, skip: F.conv(F.substring(fingerprint, i * 16 + skip + 1, F.lit(8)), 16, 10).cast("bigint")
    return F.when(F.length(fingerprint) >= 16, F.transform(at, lambda i: F.shiftleft(half(i, 0), 32).bitwiseOR(half(i, 8)))).otherwise(empty())


def union_sketch(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of two sketches' texts, 0 to 1; two texts without words are alike."""
    both = union_sketch(a, b, k)
    n = F.size(both)
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(both, a), b)) / n)


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else by how near the k-th hash lies to the least possible."""
    last = F.element_at(sketch, k).cast("double") + F.lit(2.0**63) + 0.5
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) * F.lit(2.0**64) / last)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that the second holds, 0 to 1; nothing is in everything.

    Counted among hashes that both sketches would show, up to the smaller of their last ones.
    """
    last = lambda s: F.when(F.size(s) < k, F.lit(2**63 - 1)).otherwise(F.element_at(s, k))
    shown = lambda s: F.filter(s, lambda x: (x <= last(a)) & (x <= last(b)))
    held = F.size(F.array_intersect(a, b)) / F.greatest(F.size(shown(a)), F.lit(1))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), held))


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = WORDS) -> DataFrame:
    """(id, n_chars, sketch, n_shingles) of every row; no shuffle. Null text: empty, without hashes."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    made = with_sketch(rows, "text", "sketch", k, size)
    return made.select(F.col("id").alias(id_col), F.length("text").cast("bigint").alias("n_chars"), "sketch", distinct_shingles(F.col("sketch"), k).alias("n_shingles"))


def merged(parts: DataFrame, key: str, sketch: str = "sketch", k: int = K) -> DataFrame:
    """(key, sketch, n_shingles) of all parts of each key together.

    Only the ``k`` smallest of a task's hashes of a key are shuffled, and ``k`` of a key are gathered: a hot key is no hot
    task. A null key is a key; null sketches count as empty. Shingles across the seams of parts are in no part, so texts cut
    with an overlap of four words give the whole text's sketch.
    """
    h = parts.select(F.col(f"`{key}`").alias("k"), F.explode_outer(F.col(f"`{sketch}`")).alias("h")).distinct()
    at = F.row_number().over(W.partitionBy("k").orderBy(F.asc_nulls_last("h")))
    kept = h.withColumn("at", at).where(F.col("at") <= k).groupBy("k").agg(F.sort_array(F.collect_list("h")).alias("s"))
    return kept.select(F.col("k").alias(key), F.col("s").alias(sketch), distinct_shingles(F.col("s"), k).alias("n_shingles"))


def bucket_starts(keys: DataFrame) -> list[tuple[int | None, int]]:
    """First (id, h) of the buckets in which the order is cut, ascending; each is a row's. None without rows.

    Drawn by a hash of the key, DRAWN for each bucket, so that a hot range gets as many buckets as its rows need. At most
    MOST_BUCKETS * DRAWN keys come to the driver, as columns; beyond MOST_BUCKETS * BUCKET_ROWS rows buckets grow, and spill.
    """
    n = keys.count()
    if not n:
        return []
    buckets = min(MOST_BUCKETS, n // BUCKET_ROWS + 1)
    drawn = keys.select("id", "h").orderBy(F.xxhash64("h", "id", F.lit(1)), "h", "id").limit(buckets * DRAWN).toArrow()
    low = lambda r: (r[0] is not None, r[0] or 0, r[1])
    ranked = sorted(zip(drawn.column("id").to_pylist(), drawn.column("h").to_pylist(), strict=True), key=low)
    starts = [tuple(r) for r in keys.select("id", "h").orderBy(F.asc_nulls_first("id"), "h").limit(1).collect()] + ranked[DRAWN::DRAWN]
    return [x for i, x in enumerate(starts) if not i or low(x) > low(starts[i - 1])]


def with_next(places: DataFrame, keys: DataFrame, carried: list[str]) -> DataFrame:
    """``places``, of distinct (id, h), with each ``carried`` column of the row that follows as ``next_<column>``, after the last of the first; order: id (null first), h.

    The order is cut into buckets at known ``keys``, the places' (id, h). Each bucket also gets a copy of the row that begins
    the next one, so that windows within buckets see what follows.
    """
    starts = bucket_starts(keys)
    m = len(starts)
    if not m:
        return places.select("*", *[F.col(c).alias(f"next_{c}") for c in carried]).limit(0)
    # one literal that is folded into an array when the plan is made
    marks = F.from_json(F.lit(json.dumps([{"id": i, "h": h} for i, h in starts])), "array<struct<id:bigint,h:bigint>>")
    own = F.struct(F.col("id").alias("id"), F.col("h").alias("h"))  # compared field by field, null first
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(m.bit_length()))])
    bucket = F.aggregate(steps, F.lit(0), lambda a, s: F.when(F.coalesce(F.get(marks, a + s) <= own, F.lit(False)), a + s).otherwise(a))
    at = places.withColumn("bucket", bucket)
    here = F.struct(F.col("bucket"), F.lit(False).alias("edge"))
    copy = F.struct(F.pmod(F.col("bucket") - 1, F.lit(m)).alias("bucket"), F.lit(True).alias("edge"))
    begins = F.get(marks, F.col("bucket")).eqNullSafe(own)
    dealt = at.withColumn("to", F.explode(F.when(begins, F.array(here, copy)).otherwise(F.array(here)))).withColumns({"bucket": F.col("to.bucket"), "edge": F.col("to.edge")}).drop("to")
    order = W.partitionBy("bucket").orderBy("edge", F.asc_nulls_first("id"), "h")
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).where(~F.col("edge")).drop("bucket", "edge")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = WORDS) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, contained, n_shingles) of every row.

    The edited text has its last half of code points replaced by as many from the start of the next document's (all, if it
    has fewer). ``contained``: the share of the text's shingles that the edited one holds. Estimates come from sketches.

    Order: by id, null first, then by the text's hash. Rows that repeat id and text are one place in the order, and each gets
    that place's results; counts, not copies, meet in a task. A single place is followed by itself. Null text: empty, whose
    fingerprint is empty; two empty ones are alike (1.0). Very long texts are taken whole, in one row. Empty table: no rows.
    Other columns are not read.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    keys = written(rows.groupBy("id", "h").agg(F.count("*").alias("n")))
    places, again = rows.withColumn("n", F.lit(1).cast("bigint")), keys.where("n > 1")
    if again.head(1):  # rows that are repeated: each once, with their number
        key = F.struct(F.col("id").alias("id"), F.col("h").alias("h"))
        keyed, again = rows.withColumn("key", key), again.select(key.alias("key"), "n")
        first = near_ids(keyed, again, "key").join(again, "key").groupBy("key").agg(*[F.first(c).alias(c) for c in ("id", "text", "h", "n")])
        places = without_ids(keyed, again, "key").withColumn("n", F.lit(1).cast("bigint")).drop("key").unionByName(first.drop("key"))
    follows = with_next(with_sketch(places, "text", "sketch", k, size), keys, ["text", "sketch"])
    length = F.length("text")
    half = F.floor(length / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), length - half), F.substring("next_text", F.lit(1), half))
    both = with_sketch(follows.select("id", "n", "sketch", "next_sketch", length.cast("bigint").alias("n_chars"), edited.alias("edited")), "edited", "other", k, size)
    a, b = F.col("sketch"), F.col("other")
    made = both.select(
        F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth"), F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(a).alias("fingerprint"), as_text(b).alias("edited_fingerprint"),
        resemblance(a, b, k).alias("near_edited"), resemblance(a, F.col("next_sketch"), k).alias("near_next"), containment(a, b, k).alias("contained"), distinct_shingles(a, k).alias("n_shingles"),
    )
    return made.drop("nth")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
