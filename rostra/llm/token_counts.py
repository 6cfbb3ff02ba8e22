"""Operator 1: token counts with the whole-token shortcut."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rostra.llm.common import map_texts, table
from rostra.llm.word_bpe import shared_encoder


def count_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per input row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``.

    The vocabulary's strings are first proven, once and without documents, to encode alone as one token or not; pre-tokens
    among the proven ones count as one, the others are merged, each distinct chunk once per task. Documents are mapped
    where they are read: no shuffle, so neither hot sources nor copies gather anywhere.

    Null text: 0 bytes, 0 tokens. Empty text: the same. Null id: counted like others, the id stays null. Very long text: taken whole.
    Repeated rows: each gives its row. Empty table: no rows. Other columns are not read.
    """
    get = shared_encoder(df.sparkSession, vocabulary)

    def factory():
        words = get()

        def work(texts):
            counts = words.counts(texts)
            return [[len(t.encode()) if t else 0 for t in texts], counts, [n > limit for n in counts]]

        return work

    return map_texts(df, [id_col, text_col], {id_col: "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}, factory)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
