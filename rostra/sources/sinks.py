"""Writers: sparse NDJSON, fixed-size parts, byte-bounded packs, staged publishing."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostra.operators.joins import unused

PART_ROWS = 128


def sparse(df: DataFrame) -> DataFrame:
    """Empty texts as nulls, which JSON rows leave out."""
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def write_ndjson(df: DataFrame, path: str) -> None:
    sparse(df).write.option("compression", "gzip").json(path)


def scratch_path(spark: SparkSession) -> str:
    """A new path below the shared folder named in ``spark.checkpoint.dir``; a local one only where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/rostra-{uuid.uuid4().hex}"


def materialized(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, so that it is computed once and read alike by all who use it."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def part_of(ordinal: Column, rows: int = PART_ROWS) -> Column:
    """Part of a row by its number from 1."""
    return F.ceil(ordinal / rows).cast("int")


def with_parts(df: DataFrame, order: Sequence[str], rows: int = PART_ROWS) -> DataFrame:
    """``ordinal`` and ``part`` in the order given, without sending all rows through one task.

    Rows are range-partitioned; each partition numbers its own, and only the partitions' sizes are added up in one place.
    The partitions are written first, as their numbers must be the same for both.
    """
    place, nth, size, ahead = (unused(df.columns, c) for c in ("place", "nth", "size", "ahead"))
    placed = materialized(df.repartitionByRange(*order).withColumn(place, F.spark_partition_id()))
    local = placed.withColumn(nth, F.row_number().over(W.partitionBy(place).orderBy(*order)))
    sizes = local.groupBy(place).agg(F.count("*").alias(size))
    before = sizes.select(place, F.coalesce(F.sum(size).over(W.orderBy(place).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(ahead))
    numbered = local.join(before, place).withColumn("ordinal", F.col(ahead) + F.col(nth)).drop(place, nth, ahead)
    return numbered.withColumn("part", part_of(F.col("ordinal"), rows))


def summed_up(placed: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Running sums over all rows, where ``_p`` names a row's partition in the order; only the partitions' sums meet in one place."""
    sums = placed.groupBy("_p").agg(F.sum(value).alias("_s"))
    before = sums.select("_p", F.coalesce(F.sum("_s").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    own = F.sum(value).over(W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn(name, own).join(before, "_p").withColumn(name, F.col(name) + F.col("_b")).drop("_b")


def byte_bounded_parts(df: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """(group, order, part): neighbours share a part while their bytes fit; a row larger than ``most`` has its own.

    Where a part ends depends on where the last one ended. No task holds a group: rows are range-partitioned and bytes summed
    up over all; for every row it is found where the next part would start if one started there, within stretches of
    ``most`` bytes; and the starts are followed from each group's first row by pointer doubling, so in as many rounds as
    the logarithm of the most parts of a group. Null sizes count as 0; nulls of ``order`` come last.
    """
    rows = df.select(F.col(group).alias("g"), F.col(order).alias("o"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("z"))
    by = [F.asc_nulls_first("g"), F.asc_nulls_last("o")]
    placed = materialized(rows.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    by = [*by, F.col("_i")]
    numbered = materialized(summed_up(summed_up(placed.withColumn("_1", F.lit(1).cast("bigint")), by, "_1", "n"), by, "z", "upto").drop("_1", "_i"))
    ends = numbered.groupBy("g").agg(F.min("n").alias("first"), F.max("n").alias("last"))
    held = materialized(numbered.join(ends.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g"))).drop("_g").withColumn("before", F.col("upto") - F.col("z")))
    # a part that starts with ``before`` bytes ahead of it ends where a row reaches beyond ``before + most``
    stretch = lambda c: F.floor(c / most)
    begun = held.where("z > 0").withColumn("s", F.explode(F.sequence(stretch(F.col("before")), stretch(F.col("upto") - 1))))
    begun = begun.select("first", "s", F.greatest("before", F.col("s") * most).alias("at"), F.lit(0).alias("k"), F.struct("n", "before", "upto").alias("row"))
    asked = held.select("first", (F.col("before") + most).alias("at")).distinct().select("first", stretch(F.col("at")).alias("s"), "at", F.lit(1).alias("k"))
    near = W.partitionBy("first", "s").orderBy("at", "k").rowsBetween(W.unboundedPreceding, 0)
    found = begun.unionByName(asked, allowMissingColumns=True).withColumn("row", F.last("row", ignorenulls=True).over(near)).where("k = 1 and row.upto > at")
    # a row that is larger than ``most`` and begins the part ends it as well
    found = found.select("first", (F.col("at") - most).alias("before"), (F.col("row.n") + F.when(F.col("row.before") + most > F.col("at"), 0).otherwise(1)).alias("next"))
    jump = materialized(held.join(found, ["first", "before"]).where("next <= last").select("n", "next"))
    starts = materialized(ends.select(F.col("first").alias("n")))
    while True:
        more = materialized(starts.join(jump, "n").select(F.col("next").alias("n")))
        if not more.head(1):
            break
        starts = materialized(starts.union(more))
        jump = materialized(jump.join(jump.select(F.col("n").alias("next"), F.col("next").alias("_far")), "next").select("n", F.col("_far").alias("next")))
    marked = held.join(starts.withColumn("_start", F.lit(1).cast("bigint")), "n", "left").withColumn("_start", F.coalesce("_start", F.lit(0).cast("bigint")))
    counted = materialized(summed_up(marked, ["n"], "_start", "c"))
    base = counted.where("n = first").select("first", F.col("c").alias("_c"))
    return counted.join(base, "first").select(F.col("g").alias(group), F.col("o").alias(order), (F.col("c") - F.col("_c") + 1).cast("int").alias("part"))


def json_bytes(*columns: str) -> Column:
    """Bytes of a row's columns as JSON, with the comma after it. Nulls are left out, as JSON leaves them out."""
    return (F.octet_length(F.to_json(F.struct(*columns))) + 1).cast("bigint")


def pack_weights(docs: DataFrame, doc: str, meeting: Sequence[str], children: Sequence[DataFrame], attendance: DataFrame, header: int = 0) -> DataFrame:
    """(doc, bytes): what each document brings into a pack, serialised: itself, its rows in ``children`` (tables with ``doc``), and
    the attendance of meetings (``meeting`` columns, as in ``docs``) whose first document it is. Attendance that no document
    owns, and ``header`` bytes, go with the first document. Rows of documents that do not exist count nowhere. Null
    meetings own nothing. Each table is summed by key before anything is joined."""
    own = docs.select(doc, json_bytes(*docs.columns).alias("z"))
    summed = [own, *[c.select(doc, json_bytes(*c.columns).alias("z")).groupBy(doc).agg(F.sum("z").alias("z")).join(docs.select(doc), doc, "left_semi") for c in children]]
    owners = docs.groupBy(*meeting).agg(F.min(doc).alias(doc))
    of_meeting = attendance.select(*meeting, json_bytes(*attendance.columns).alias("z")).groupBy(*meeting).agg(F.sum("z").alias("z")).join(owners, list(meeting), "left")
    first = docs.agg(F.min(doc).alias("first"))  # one row
    loose = of_meeting.crossJoin(F.broadcast(first)).select(F.coalesce(doc, "first").alias(doc), "z")
    with_header = first.where("first is not null").select(F.col("first").alias(doc), F.lit(header).cast("bigint").alias("z"))
    every = loose.unionByName(with_header)
    for s in summed:
        every = every.unionByName(s)
    return every.where(F.col(doc).isNotNull()).groupBy(doc).agg(F.sum("z").alias("bytes"))


def pack_parts(weights: DataFrame, doc: str, most: int, refuse: bool = True) -> DataFrame:
    """(doc, bytes, part): the longest runs of documents whose weights fit into ``most`` bytes. A single document beyond it raises;
    without ``refuse`` it warns, and the parts end before that document."""
    held = materialized(weights.select(doc, "bytes"))
    over = held.where(F.col("bytes") > most).orderBy(doc).select(doc, "bytes").head()
    if over is not None:
        said = f"document {over[0]} needs {over[1]} bytes; a part holds {most}"
        if refuse:
            raise ValueError(said)
        warnings.warn(f"{said}: parts end before it", stacklevel=2)
        held = held.where(F.col(doc) < F.lit(over[0]))
    parts = byte_bounded_parts(held.withColumn("pack", F.lit(1)), "pack", doc, "bytes", most)
    return held.join(parts.select(doc, "part"), doc)


def upserted(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Old rows with the new ones' values where they have any, and new rows besides."""
    name = {c: unused([key, *columns], f"new_{c}") for c in columns}
    fresh = new.select(key, *[F.col(c).alias(name[c]) for c in columns])
    return old.select(key, *columns).join(fresh, key, "full").select(key, *[F.coalesce(F.nullif(F.col(name[c]), F.lit("")), F.col(c)).alias(c) for c in columns])


def merged_diaries(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pack, missing) of rows (url, title, diary): a new row's number goes to the old row of its url, or else of its title; new
    rows that match neither are added. ``missing`` are the rows that still have none. Of several numbers the smallest counts."""
    number = F.nullif(F.trim(F.coalesce("diary", F.lit(""))), F.lit(""))
    fresh = new.select("url", "title", number.alias("d")).where("d is not null")
    by_url = fresh.groupBy("url").agg(F.min("d").alias("d_url"))
    rest = fresh.join(old.select("url"), "url", "left_anti")
    by_title = rest.groupBy("title").agg(F.min("d").alias("d_title"))
    pack = old.join(by_url, "url", "left").join(by_title, "title", "left").select("url", "title", F.coalesce("d_url", "d_title", number).alias("diary"))
    added = rest.join(old.select("title"), "title", "left_anti").groupBy("url").agg(F.min(F.struct("d", "title")).alias("m")).select("url", "m.title", F.col("m.d").alias("diary"))
    pack = pack.unionByName(added)
    return pack, pack.where("diary is null").select("url", "title")


def bootstrap(rows: DataFrame, order: Sequence[Column], facets: Sequence[str], n: int = 8) -> DataFrame:
    """The first rows in order, each with the number of all rows and of each facet's values: what a page shows before the rest is read."""
    totals = rows.agg(F.count("*").alias("total"), *[F.count_distinct(c).alias(f"n_{c}") for c in facets])
    return rows.orderBy(*order).limit(n).join(F.broadcast(totals))  # one row


def publish(spark: SparkSession, df: DataFrame, path: str, valid: Callable[[DataFrame], bool]) -> bool:
    """Writes beside ``path``, checks what was written, and only then renames; what was published before stays until then.

    Uses Hadoop's file system of the path, so it works on any store that can rename.
    """
    staged, kept = f"{path}.staged-{uuid.uuid4().hex}", f"{path}.kept-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    if not valid(spark.read.schema(df.schema).parquet(staged)):
        fs.delete(at(staged), True)
        return False
    had = fs.exists(at(path))
    if had and not fs.rename(at(path), at(kept)):
        fs.delete(at(staged), True)
        return False
    if not fs.rename(at(staged), at(path)):
        if had:
            fs.rename(at(kept), at(path))
        return False
    if had:
        fs.delete(at(kept), True)
    return True
