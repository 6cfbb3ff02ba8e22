"""Semi, anti, range, as-of and repair joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unused(columns: Sequence[str], name: str) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt over many tasks by key, in a number of parts that nothing coalesces.

    For work that costs far more than its bytes tell: patterns over texts made from a small file, which is read by one task,
    and hash tables of keys that hardly repeat, where a part's compressed bytes say little of what it needs in memory.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def prune(rows: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key still exists."""
    return rows.join(kept.select(*keys).distinct(), list(keys), "left_semi")


def new_only(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not known yet."""
    return rows.join(known.select(*keys), list(keys), "left_anti")


def reconcile_attendance(attendance: DataFrame, ballots: DataFrame, keys: Sequence[str] = ("meeting", "name", "party"), absent: str = "Frånvarande") -> DataFrame:
    """Attendance with everyone added who voted without being listed, their role ``verified``."""
    voters = ballots.where(F.col("vote") != absent).select(*keys).distinct()
    missing = voters.join(attendance.select(*keys), list(keys), "left_anti")
    return attendance.select(*keys, "role").unionByName(missing.withColumn("role", F.lit("verified")))


def orphan_fragments(people: DataFrame, meeting: str = "meeting", party: str = "party", name: str = "name", verified: str = "verified") -> DataFrame:
    """One-word names to remove: the last word of a fuller name of the same meeting and party that is verified, while the fragment is not.

    Blocked on meeting, party and last word, so it is an equi join.
    """
    last = F.element_at(F.split(name, " "), -1)
    split = people.select(meeting, party, name, verified, last.alias("last"))
    one = split.where((F.col(name) == F.col("last")) & ~F.col(verified))
    full = split.where((F.col(name) != F.col("last")) & F.col(verified)).select(meeting, party, "last").distinct()
    return one.join(full, [meeting, party, "last"], "left_semi").select(meeting, party, name)


def corrected(rows: DataFrame, corrections: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns replaced where a correction says so."""
    new = {c: unused(rows.columns, f"new_{c}") for c in columns}
    fixes = corrections.select(key, *[F.col(c).alias(new[c]) for c in columns])
    return rows.join(fixes, key, "left").select(*[F.coalesce(new[c], c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def coalesced_lookup(rows: DataFrame, tables: Sequence[tuple[DataFrame, str]], value: str) -> DataFrame:
    """``value`` from the first of several lookups that knows the row's key."""
    names = [unused(rows.columns, f"found{i}") for i in range(len(tables))]
    for name, (lookup, key) in zip(names, tables, strict=True):
        rows = rows.join(lookup.select(key, F.col(value).alias(name)), key, "left")
    return rows.withColumn(value, F.coalesce(*names)).drop(*names)


def range_first(points: DataFrame, ranges: DataFrame, group: str, at: str, begin: str, end: str, order: str, width: int = 64) -> DataFrame:
    """Each point with the first range (by ``order``) of its group that covers it.

    Ranges are spread over buckets of ``width`` and joined by equality on (group, bucket), never by a nested loop.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    b = unused([*points.columns, *ranges.columns], "bucket")
    spread = ranges.select(group, begin, end, order).withColumn(b, F.explode(F.sequence(bucket(begin), bucket(end))))
    hits = points.select(group, at).distinct().withColumn(b, bucket(at)).join(spread, [group, b]).where(F.col(at).between(F.col(begin), F.col(end)))
    return points.join(hits.groupBy(group, at).agg(F.min(order).alias(order)), [group, at], "left")


def forward_asof(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, right_at: str, value: str) -> DataFrame:
    """Each left row with the earliest right row at or after it. Both sides are merged and scanned backwards once per key."""
    found, asks = unused([*left.columns, value], "found"), unused([*left.columns, value], "asks")
    a = left.select(*left.columns, F.lit(None).cast(right.schema[value].dataType).alias(found), F.lit(1).alias(asks))
    b = right.select(*keys, F.col(right_at).alias(at), F.col(value).alias(found), F.lit(0).alias(asks))
    order = W.partitionBy(*keys).orderBy(F.desc(at), F.asc(asks), F.desc(found)).rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last(F.when(F.col(asks) == 0, F.col(found)), ignorenulls=True).over(order))
    return both.where(F.col(asks) == 1).select(*left.columns, value)


def runs_found(pages: DataFrame, doc: str, at: str, signature: str) -> DataFrame:
    """(part, found, shift): documents whose pages all stand in a document, in their order, ``shift`` places on; each stands in itself.

    Candidates are found by each document's rarest page alone, and only they are compared page by page, so a page that very
    many documents share brings none together by itself.
    """
    counts = pages.groupBy(signature).agg(F.count("*").alias("c"))
    known = pages.select(F.col(doc).alias("part"), F.col(at).alias("t"), signature).join(counts, signature)
    rarest = known.groupBy("part").agg(F.min(F.struct("c", "t", signature)).alias("m"), F.count("*").alias("n")).select("part", "n", F.col("m.t").alias("t"), F.col(f"m.{signature}").alias(signature))
    where = pages.select(F.col(doc).alias("found"), F.col(at).alias("place"), signature)
    maybe = rarest.join(where, signature).select("part", "n", "found", (F.col("place") - F.col("t")).alias("shift")).distinct()
    told = maybe.join(known.select("part", "t", signature), "part").withColumn("place", F.col("t") + F.col("shift"))
    return told.join(where, ["found", "place", signature]).groupBy("part", "found", "shift", "n").agg(F.count("*").alias("c")).where("c = n").select("part", "found", "shift")


def section_sets(pending: DataFrame, stored: DataFrame, key: str, item: str) -> DataFrame:
    """Per key the sections of both sides, as counts of common, new and missing ones, and what follows for the key."""
    a = pending.groupBy(key).agg(F.collect_set(item).alias("a"))
    b = stored.groupBy(key).agg(F.collect_set(item).alias("b"))
    both = a.join(b, key, "left").withColumn("b", F.coalesce("b", F.array().cast("array<string>")))
    state = F.when(F.size("b") == 0, "pending").when(~F.arrays_overlap("a", "b"), "conflict").when(F.size(F.array_except("a", "b")) > 0, "supplement").otherwise("known")
    return both.select(key, F.size(F.array_intersect("a", "b")).alias("common"), F.size(F.array_except("a", "b")).alias("added"), F.size(F.array_except("b", "a")).alias("missing"), state.alias("state"))
