"""Window-like passes: occurrences, representatives, runs, carried values, ranks and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostra.operators.joins import spread, unused


def disambiguated(df: DataFrame, key: str, position: str, out: str = "unique_id") -> DataFrame:
    """The first occurrence keeps its id, later ones get ``__source_<position>``."""
    n = F.row_number().over(W.partitionBy(key).orderBy(position))
    return df.withColumn(out, F.when(n == 1, F.col(key).cast("string")).otherwise(F.concat(F.col(key).cast("string"), F.lit("__source_"), F.col(position).cast("string"))))


def last_wins(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """One row per key: the last value, at the first one's position."""
    latest = F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.col(position)).alias("r")
    return df.groupBy(*keys).agg(F.min(position).alias("first_position"), latest).select(*keys, "first_position", "r.*")


def most_frequent(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's most frequent value; ties go to the longer, then the smaller one. Counts are aggregated before any ordering."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    rank = unused(counts.columns, "rank")
    top = counts.withColumn(rank, F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), F.desc(F.length(value)), value)))
    return top.where(F.col(rank) == 1).select(key, value, "n")


def carried_forward(df: DataFrame, keys: Sequence[str], order: str, heading: Column, out: str = "heading") -> DataFrame:
    """The last heading at or before each row."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.last(heading, ignorenulls=True).over(w))


def sections(df: DataFrame, keys: Sequence[str], order: str, start: Column) -> DataFrame:
    """(keys, section, first, last, n): stretches from each start to before the next; rows before the first start are section 0."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    numbered = df.withColumn("section", F.sum(start.cast("int")).over(w))
    return numbered.groupBy(*keys, "section").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def after_marker(df: DataFrame, keys: Sequence[str], order: str, marker: Column) -> DataFrame:
    """``second``: whether a marker stands before the row."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("second", F.coalesce(F.max(marker.cast("int")).over(w), F.lit(0)) == 1)


def encode_ranges(df: DataFrame, key: str, value: str) -> DataFrame:
    """Runs of consecutive distinct integers as (key, begin, length)."""
    # dealt by key once, for the distinct rows, the window and the runs alike
    distinct = spread(df.select(key, value), key).distinct()
    island = F.col(value) - F.row_number().over(W.partitionBy(key).orderBy(value))
    name = unused(distinct.columns, "island")
    return distinct.withColumn(name, island).groupBy(key, name).agg(F.min(value).alias("begin"), F.count("*").alias("length")).drop(name)


def decode_ranges(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.select(key, F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("length") - 1)).alias(value))


def share_of_total(df: DataFrame, value: str, out: str = "share") -> DataFrame:
    """Each row's part of the whole column. The total is one row, joined to all."""
    name = unused(df.columns, "total")
    total = df.agg(F.sum(value).alias(name))
    return df.join(F.broadcast(total)).withColumn(out, F.when(F.col(name) != 0, F.col(value) / F.col(name)).otherwise(0.0)).drop(name)


def numeric_key(text: Column) -> Column:
    """A sort key in which runs of digits order by their value, however long: each gets its number of digits before it, and
    that number's own length before that."""
    bare = F.regexp_replace(F.lower(text), "(?<![0-9])0+(?=[0-9])", "")
    runs, rest = F.regexp_extract_all(bare, F.lit("([0-9]+)"), F.lit(1)), F.split(bare, "[0-9]+")
    size = lambda x: F.length(x).cast("string")
    keyed = F.transform(runs, lambda x: F.concat(F.length(size(x)).cast("string"), size(x), x))
    return F.array_join(F.flatten(F.transform(F.arrays_zip(rest.alias("a"), keyed.alias("b")), lambda p: F.array_compact(F.array(p["a"], p["b"])))), "")


def ordered(columns: Sequence[tuple[Column, bool]], descending: bool) -> list[Column]:
    """Sort keys in one direction; descending order turns tie-breakers round as well. (column, True) keeps its direction."""
    return [c.asc() if fixed or not descending else c.desc() for c, fixed in columns]


def page(df: DataFrame, order: Sequence[Column], number: int, size: int, cumulative: bool = False) -> DataFrame:
    """A page of the ordered rows, or all up to it."""
    first = df.orderBy(*order)
    return first.limit((number + 1) * size) if cumulative else first.offset(number * size).limit(size)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows with their ranks; only k rows of each partition travel."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def fixed_order(value: Column, values: Sequence[str]) -> Column:
    """Position in a fixed list; unknown values come last."""
    at = F.array_position(F.array(*[F.lit(v) for v in values]), value)
    return F.when(at > 0, at).otherwise(len(values) + 1).cast("int")
