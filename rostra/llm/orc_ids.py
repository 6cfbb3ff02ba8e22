"""Operator 10: token ids as ORC files."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostra.llm.common import batch_map, shared_dir, slices, table
from rostra.llm.word_bpe import shared_encoder

STRIPE_BYTES, INDEX_STRIDE = 32 << 20, 1000


def write_ids(df: DataFrame, vocabulary: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> str:
    """Writes documents' token ids below ``path`` in ascending order of ids, and returns the path.

    Columns: ``doc_id``, ``file_start`` (ids before it in its file), ``n_tokens`` (with the end id), ``ids``. Files follow one
    another by the number of the partition in their names. Stripes use integer run-length encoding; the row index lets readers skip by ``doc_id``, and Bloom
    filters on ``doc_id`` skip row groups in point reads. Readers take stripes in parallel.

    Range partitions hold neighbouring documents; rows with one id are parted by their texts' hashes, so a hot id is no
    hot task. Null text: only the end id. Very long text: taken whole. Repeated rows: each is written. Null id: first.
    Empty table: one file without rows, or none. Other columns are not read.
    """
    get = shared_encoder(df.sparkSession, vocabulary)
    end = np.array([end_id], "<u4").tobytes()

    def factory():
        words, start = get(), 0

        def work(batch):
            nonlocal start
            for part in slices(batch, 1, 4 << 20):
                packed = words.ids(part.column(1).to_pylist())
                flat = np.frombuffer(b"".join([x for p in packed for x in (p, end)]), "<i4")
                sizes = np.array([len(p) // 4 + 1 for p in packed], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(start + offsets[:-1]), pa.array(sizes), ids], names=["doc_id", "file_start", "n_tokens", "ids"])
                start += int(offsets[-1])

        return work

    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    placed = docs.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    made = batch_map(placed, factory, "doc_id bigint, file_start bigint, n_tokens bigint, ids array<int>")
    made.write.option("compression", "none").option("maxRecordsPerFile", 0).option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", INDEX_STRIDE).option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).orc(path)
    return path


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_ids`` wrote; filters on ``doc_id`` are pushed down to row indexes and Bloom filters."""
    return spark.read.schema("doc_id bigint, file_start bigint, n_tokens bigint, ids array<int>").orc(path)


def file_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(file, before): ids in all files before each. Sums are made per file first; one row per file is ordered."""
    files = read_ids(spark, path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.sum("n_tokens").alias("n"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("bigint")
    before = W.orderBy(number, "file").rowsBetween(W.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def positions(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``, read from the files."""
    rows = read_ids(spark, path).select("doc_id", "file_start", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"))

    def check(b):
        ids = b.column(3)
        flat, offsets = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)), ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64()), b.column(4)], names=["doc_id", "file_start", "n_tokens", "ids_crc32", "file"])

    checked = batch_map(rows, lambda: check, "doc_id bigint, file_start bigint, n_tokens bigint, ids_crc32 bigint, file string")
    return checked.join(file_offsets(spark, path), "file").select("doc_id", (F.col("before") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")


def op10_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), shared_dir(spark))
    return positions(spark, path)
