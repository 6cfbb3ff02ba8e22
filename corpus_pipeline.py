"""A corpus pipeline over ``documents``: language ID, near-duplicates, benchmark decontamination, token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.llm import byte_bpe, decontaminate, language, near_dedup
from rostra.llm.common import near_ids, table, unused, without_ids, written

#: How far a document's language must stand out: this part of the way from an even guess to certainty.
LEAST_MARGIN = 0.1
#: Documents of whose words a larger part lies in benchmark passages go.
MOST_COVERAGE = 0.0


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language stay; texts that are null, without letters or like no language go. Very long
    texts are judged whole, repeated rows and rows without id each by its text; without labels no document has a language.
    Empty table: no rows.
    """
    return language.accepted(docs, language.train(docs), least_margin=LEAST_MARGIN)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near-duplicates stays, the one with the smallest id; of rows that repeat an id and its
    text, one. Other texts of the same id are judged on their own. Rows without id, and texts without words, stay. Very long
    texts: taken whole. Empty table: no rows.
    """
    rows = written(near_dedup.kept_texts(docs))
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("kept").alias("kept"))
    found = written(ids.where("n > 1 or not kept"))
    left = without_ids(docs.where(F.col("doc_id").isNotNull()), found, "doc_id").unionByName(docs.where(F.col("doc_id").isNull()))
    again = found.where("n > 1")  # ids that several rows have
    if not again.head(1):
        return left
    same = unused(docs, "same")
    more = near_ids(docs, again, "doc_id").join(again, "doc_id", "left_semi").select(*docs.columns).withColumn(same, near_dedup.text_class("text"))
    good = rows.where("kept").select("doc_id", F.col("same").alias(same)).distinct()
    return left.unionByName(more.dropDuplicates(["doc_id", same]).join(good, ["doc_id", same], "left_semi").select(*docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark stay, also null, empty and wordless ones. Very long texts are judged whole,
    repeated rows and rows without id each by its text. Empty benchmark: all stay. Empty table: no rows.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), max_coverage=MOST_COVERAGE)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with hashes of ids and of the decoded bytes; a row for each row, nulls as empty texts, very
    long texts whole. Empty table: no rows.
    """
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", encoding_stage),
]

#: The first stage is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
