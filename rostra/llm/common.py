"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only for sessions that name no checkpoint folder (tests, local mode).
LOCAL_SHARED = "file:///tmp/checkpoints"
#: UTF-8 bytes that a Python task holds as Python strings at a time (one longer text is still taken whole).
CHUNK_BYTES = 1 << 20

#: Rows of broadcast tables that turn most rows away before a join on ids, at most; each holds 64 hash slots as bits. With n
#: ids, about n in 33,554,432 of the other rows pass too: beyond some 10 million ids the join shuffles most rows once.
SLOT_WORDS = 1 << 19

PA_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}


#: Rows of an Arrow batch, at most; JVM and Python worker each hold one or two per task.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to BATCH_ROWS: texts are long, and the default of 10,000 rows is made for numbers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def release_memory() -> None:
    """Gives memory that a finished task has freed back to the system; its worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # C libraries other than glibc have no such call
        ctypes.CDLL(None).malloc_trim(0)


def batch_map(df: DataFrame, factory: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema) -> DataFrame:
    """``mapInArrow`` of a function that is made once per task and maps a batch to batches."""
    small_batches(df.sparkSession)

    def run(batches):
        work = factory()
        for batch in batches:
            yield from work(batch)
        del work
        release_memory()

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that the cluster names in ``spark.checkpoint.dir``; the path itself is made by the writer."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or LOCAL_SHARED
    return f"{base.rstrip('/')}/rostra-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it is computed once, and lost executors cost no recomputation of what lies before."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_file(spark: SparkSession, path: str, limit: int = 64 << 20):
    """The bytes of a vocabulary file as a broadcast variable; refuses files above ``limit`` bytes."""
    if (n := os.path.getsize(path)) > limit:
        raise ValueError(f"{path} has {n} bytes; at most {limit} are broadcast")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def slices(batch: pa.RecordBatch, column: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about ``most`` bytes of the given text column, and a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(df: DataFrame, columns: list[str], schema: dict[str, str], factory: Callable[[], Callable]) -> DataFrame:
    """Maps texts in Arrow batches; no shuffle.

    ``columns``: the id, which is passed on, and the text.
    ``schema``: names and types of all columns returned, the id first.
    ``factory``: runs once per task and gives a function from a list of texts to one list per new column.
    Only these columns are read, so others, whatever their names, neither cost nor clash.
    """
    names, kinds = list(schema), [PA_TYPES[x] for x in schema.values()]
    src = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])

    def per_task():
        work = factory()

        def mapped(whole):
            for part in slices(whole, len(columns) - 1):
                made = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(work(part.column(len(columns) - 1).to_pylist()), kinds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(kinds[0]), *made], names=names)

        return mapped

    return batch_map(src, per_task, ", ".join(f"`{n}` {t}" for n, t in schema.items()))


def slot(id_col: str) -> tuple[Column, Column]:
    """An id's word of slots, and its bit there."""
    h = F.pmod(F.xxhash64(id_col), F.lit(SLOT_WORDS * 64))
    return F.shiftright(h, 6), h.bitwiseAND(F.lit(63)).cast("int")


def near_ids(df: DataFrame, ids: DataFrame, id_col: str = "id", turned_away: bool = False) -> DataFrame:
    """Rows whose id shares a hash slot with one of ``ids`` (or those whose id does not). The slots are broadcast: SLOT_WORDS rows at most."""
    word, bit = slot(id_col)
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    names = [unused(df, "word"), unused(df, "bits")]
    slots = F.broadcast(ids.groupBy(word.alias(names[0])).agg(bits.alias(names[1])))
    held = (word == slots[names[0]]) & (F.getbit(slots[names[1]], bit) == 1)
    return df.join(slots, held, "left_anti" if turned_away else "left_semi")


def in_batches(df: DataFrame, most: int, id_col: str = "id") -> Iterator[list]:
    """The rows of a table, of which no two have an id in common, at most so many at a time at the driver, in order of id."""
    after = None
    while True:
        rows = (df if after is None else df.where(F.col(id_col) > after)).orderBy(id_col).limit(most).collect()
        if not rows:
            return
        yield rows
        after = rows[-1][id_col]


def without_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id is not among ``ids``. Rows that share no slot with any pass where they are read; only the others are shuffled."""
    return near_ids(df, ids, id_col, turned_away=True).unionByName(near_ids(df, ids, id_col).join(ids.select(id_col), id_col, "left_anti").select(*df.columns))
