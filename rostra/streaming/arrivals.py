"""Arriving rows: progressive results, incremental ingestion and idempotent merges."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostra.operators.joins import unused
from rostra.sources.sinks import materialized


def arriving(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1, kind: str = "parquet") -> DataFrame:
    """A stream over files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def running_summary(stream: DataFrame, keys: Sequence[str], measures: dict) -> DataFrame:
    """Counts and sums by key that hold for all that has arrived; its final state equals the batch result."""
    return stream.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(name) for name, c in measures.items()])


class Versions:
    """Finished tables below a path, named by a number, such as a batch's: found by listing names, so that none of the others is
    opened. A table is finished once its writer has left ``_SUCCESS`` there, which Spark's does unless it is told not to."""

    def __init__(self, spark: SparkSession, path: str, prefix: str = "v"):
        self.spark, self.path, self.prefix = spark, path.rstrip("/"), prefix
        self.at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self.at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def named(self, number: int) -> str:
        return f"{self.path}/{self.prefix}{number}"

    def numbers(self) -> list[int]:
        """Of those that were written to the end, ascending."""
        if not self.fs.exists(self.at(self.path)):
            return []
        names = [f.getPath().getName().removeprefix(self.prefix) for f in self.fs.listStatus(self.at(self.path)) if f.getPath().getName().startswith(self.prefix)]
        return sorted(int(n) for n in names if n.isdigit() and self.fs.exists(self.at(f"{self.named(int(n))}/_SUCCESS")))

    def read(self, schema, *numbers: int) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[self.named(n) for n in numbers])

    def drop(self, *numbers: int) -> None:
        for n in numbers:
            self.fs.delete(self.at(self.named(n)), True)


class RunningTopK:
    """For ``foreachBatch``: the k best rows of all batches so far, one for each key, kept as tables named by batch.

    Rows of a key are reduced to its best one before the k best are taken. A batch merges with the last finished one before
    it, so a batch that is given again, also after a restart, writes the same rows again. Only k rows of the state are
    read; tables from before that one go, as only the last batch can be given again.
    """

    def __init__(self, path: str, order: Sequence, key: str, k: int):
        self.path, self.order, self.key, self.k = path.rstrip("/"), list(order), key, k

    def before(self, spark: SparkSession, schema, batch_id: int | None = None) -> DataFrame | None:
        """The table of the last batch, or of the last one before ``batch_id``."""
        held = Versions(spark, self.path)
        known = [n for n in held.numbers() if batch_id is None or n < batch_id]
        return held.read(schema, known[-1]) if known else None

    def best(self, df: DataFrame) -> DataFrame:
        place, rank = W.partitionBy(self.key).orderBy(*self.order), unused(df.columns, "rank")
        return df.withColumn(rank, F.row_number().over(place)).where(F.col(rank) == 1).drop(rank).orderBy(*self.order).limit(self.k)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        best, before = self.best(batch), self.before(batch.sparkSession, batch.schema, batch_id)
        best = best if before is None else self.best(before.unionByName(best))
        best.write.mode("overwrite").parquet(f"{self.path}/v{batch_id}")
        held = Versions(batch.sparkSession, self.path)
        held.drop(*[n for n in held.numbers() if n < batch_id][:-1])

    def result(self, spark: SparkSession, schema) -> DataFrame:
        found = self.before(spark, schema)
        return spark.createDataFrame([], schema) if found is None else found


class RunningSummary:
    """For ``foreachBatch``: counts and sums by key as partial tables, one for each batch, that any later question merges.

    A batch is aggregated and written by its number; every ``compact`` batches the partial tables become one, and those in it
    go. Nothing is held in the driver or in a query's memory: ``result`` adds up what lies in the files, for all keys or
    some, under a filter that need not have been known when the rows came. So a new filter catches up from the partial
    tables, and the stream goes on.

    A batch that is given again writes its table again, or is left out where a compacted one holds it already; a compaction
    that broke off is made anew. Null keys are keys; null measures count in ``n`` and add nothing.
    """

    def __init__(self, path: str, keys: Sequence[str], measures: Mapping[str, str], compact: int = 16):
        self.path, self.keys, self.measures, self.compact = path.rstrip("/"), list(keys), dict(measures), compact

    def merged(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in self.measures])

    def parts(self, spark: SparkSession, upto: int | None = None):
        """((compacted tables, numbers), (partial tables, numbers after the last compacted one)), up to a batch."""
        whole, parts = Versions(spark, self.path, "upto"), Versions(spark, self.path)
        done = [n for n in whole.numbers() if upto is None or n <= upto]
        last = done[-1] if done else -1
        return (whole, done[-1:]), (parts, [n for n in parts.numbers() if n > last and (upto is None or n <= upto)])

    def partials(self, spark: SparkSession, schema, upto: int | None = None) -> DataFrame | None:
        out = None
        for held, numbers in self.parts(spark, upto):
            if numbers:
                found = held.read(schema, *numbers)
                out = found if out is None else out.unionByName(found)
        return out

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        whole, parts = Versions(spark, self.path, "upto"), Versions(spark, self.path)
        if not [n for n in whole.numbers() if n >= batch_id]:
            made = batch.groupBy(*self.keys).agg(F.count("*").alias("n"), *[F.sum(c).cast("double" if dict(batch.dtypes)[c] in ("float", "double") else "bigint").alias(m) for m, c in self.measures.items()])
            made.write.mode("overwrite").parquet(parts.named(batch_id))
            if (batch_id + 1) % self.compact == 0:
                every = self.partials(spark, made.schema, batch_id)
                self.merged(every, self.keys).select(*made.columns).write.mode("overwrite").parquet(whole.named(batch_id))
        done = whole.numbers()
        if done:  # what the last compacted table holds
            parts.drop(*[n for n in parts.numbers() if n <= done[-1]])
            whole.drop(*done[:-1])

    def result(self, spark: SparkSession, schema, keys: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
        """(keys, n, measures) of all that has arrived; ``schema`` is that of the arriving rows."""
        kinds = {f.name: f.dataType.simpleString() for f in schema}
        fields = [*[f"`{k}` {kinds[k]}" for k in self.keys], "n bigint", *[f"`{m}` {'double' if kinds[c] in ('float', 'double') else 'bigint'}" for m, c in self.measures.items()]]
        held = self.partials(spark, ", ".join(fields))
        held = spark.createDataFrame([], ", ".join(fields)) if held is None else held
        return self.merged(held if where is None else held.where(where), self.keys if keys is None else keys)


class Locked(RuntimeError):
    """Another run holds the lock."""


class RunLock:
    """A lock as a file in a shared folder, made only where there is none; the file system decides between two at once.

    A lock older than ``stale_s`` seconds is of a run that was lost, and is broken.
    """

    def __init__(self, spark: SparkSession, path: str, stale_s: int = 6 * 3600):
        self.at, self.stale_ms = spark._jvm.org.apache.hadoop.fs.Path(path), stale_s * 1000
        self.fs = self.at.getFileSystem(spark._jsc.hadoopConfiguration())
        self.now = lambda: spark._jvm.java.lang.System.currentTimeMillis()

    def stale(self, at) -> bool:
        return self.now() - self.fs.getFileStatus(at).getModificationTime() > self.stale_ms

    def __enter__(self) -> RunLock:
        if self.fs.exists(self.at) and self.stale(self.at):
            aside = self.at.suffix(f".{uuid.uuid4().hex}")
            if self.fs.rename(self.at, aside):  # one of several does
                if not self.stale(aside):  # another run was faster and began
                    self.fs.rename(aside, self.at)
                    raise Locked(f"another run is active: {self.at}")
                self.fs.delete(aside, False)
        self.fs.mkdirs(self.at.getParent())
        if not self.fs.createNewFile(self.at):
            raise Locked(f"another run is active: {self.at}")
        return self

    def __exit__(self, *_) -> None:
        self.fs.delete(self.at, False)


class IngestionLedger:
    """What has been ingested: (key, status, tries), kept as tables named by run.

    A run takes rows that are live and new, or whose status asks for another try, gives them to ``work``, and enters what it
    returns: (key, status). A row without status failed: it leaves no entry, and is new again. Tries count entered runs. A
    run without work leaves all as it is. Runs exclude each other by a lock; state is read after the lock is taken, and a
    run that breaks off changes nothing.
    """

    SCHEMA = "key string, status string, tries int"

    def __init__(self, spark: SparkSession, path: str, retry: Sequence[str] = ("needs_review",), most_tries: int | None = None):
        self.spark, self.path, self.retry, self.most_tries = spark, path.rstrip("/"), list(retry), most_tries
        self.held = Versions(spark, f"{self.path}/state")

    def state(self) -> DataFrame:
        known = self.held.numbers()
        return self.held.read(self.SCHEMA, known[-1]) if known else self.spark.createDataFrame([], self.SCHEMA)

    def due(self, live: DataFrame, state: DataFrame) -> DataFrame:
        """Live rows to be worked on, each key once, with ``tries`` so far. Null keys are none."""
        rows = live.where("key is not null").dropDuplicates(["key"])
        again = F.col("status").isin(self.retry) & (F.lit(True) if self.most_tries is None else F.col("tries") < self.most_tries)
        return rows.join(state, "key", "left").where(F.col("status").isNull() | again).withColumn("tries", F.coalesce("tries", F.lit(0)))

    def run(self, live: DataFrame, work: Callable[[DataFrame], DataFrame]) -> int | None:
        """The number of rows entered, or None where another run is active."""
        try:
            with RunLock(self.spark, f"{self.path}/lock"):
                state = self.state()
                due = materialized(self.due(live, state))
                if not due.head(1):
                    return 0
                done = materialized(work(due).select("key", "status").where("status is not null"))
                n = done.count()
                if n:
                    last = F.coalesce(F.col("tries"), F.lit(0)) + F.when(F.col("now").isNotNull(), 1).otherwise(0)
                    merged = state.join(done.withColumnRenamed("status", "now"), "key", "full").select("key", F.coalesce("now", "status").alias("status"), last.cast("int").alias("tries"))
                    known = self.held.numbers()
                    number = known[-1] + 1 if known else 0
                    merged.write.mode("overwrite").parquet(self.held.named(number))
                    self.held.drop(*known[:-1])  # the one before stays for those who read it
                return n
        except Locked:
            return None

    def on_batch(self, work: Callable[[DataFrame], DataFrame]):
        """For ``foreachBatch`` of live rows that arrive; a batch given again finds its rows done. Raises where another run is active."""

        def run(batch: DataFrame, batch_id: int) -> None:
            if self.run(batch, work) is None:
                raise Locked(self.path)

        return run


def new_work(live: DataFrame, state: DataFrame, key: str = "url", retry: Sequence[str] = ("needs_review",)) -> DataFrame:
    """Live rows that are not done: unknown ones, and those to be tried again."""
    done = state.where(~F.col("status").isin(*retry)).select(key)
    return live.join(done, key, "left_anti")


def merged_pack(old_docs: DataFrame, new_docs: DataFrame, old_rows: DataFrame, new_rows: DataFrame, index: str = "doc_index", same: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Documents and their rows appended, the new ones' indexes moved behind the old; rows that repeat are left out."""
    name = unused([*old_docs.columns, *new_rows.columns, *new_docs.columns], "shift")
    moved = old_docs.agg((F.coalesce(F.max(index), F.lit(-1)) + 1).alias(name))
    shift = lambda df: df.join(F.broadcast(moved)).withColumn(index, F.col(index) + F.col(name)).drop(name)
    rows = old_rows.unionByName(shift(new_rows))
    return old_docs.unionByName(shift(new_docs)), rows.dropDuplicates(list(same)) if same else rows
