"""Operator 3: byte-level BPE, encoding and decoding."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.llm.common import broadcast_file, map_texts, table
from rostra.llm.merging import Cache, PairMerger
from rostra.llm.pretokens import STOP, boundaries

#: Bytes of distinct pre-tokens cached per worker in each of two generations, about; fewer cost time only.
CACHE = 48 << 20


class ByteBpe:
    """Ids of whole texts by a file of ranks, and back.

    Boundaries come from the scans of ``pretokens``; each distinct slice between them is merged once and kept.
    """

    def __init__(self, ranks: bytes):
        vocab = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        pairs = [(vocab[t[:k]], vocab[t[k:]], rank, rank) for t, rank in vocab.items() for k in range(1, len(t)) if t[:k] in vocab and t[k:] in vocab]
        self.merger = PairMerger(pairs, np.array([vocab[bytes([b])] for b in range(256)]))
        self.cache = Cache(CACHE)
        size = max(vocab.values()) + 1
        tokens = [b""] * size
        for t, i in vocab.items():
            tokens[i] = t
        self.sizes = np.array([len(t) for t in tokens])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; a null is an empty text."""
        held = "\U0010ffff".join(t or "" for t in texts) + "\U0010ffff"
        points = np.frombuffer(held.encode("utf-32-le"), np.uint32).copy()
        ends = np.cumsum([len(t or "") + 1 for t in texts]) - 1
        points[ends] = STOP
        cuts = boundaries(points).tolist()
        words = [held[a:b] for a, b in zip(cuts, [*cuts[1:], len(held)], strict=True)]
        at, out, first = self.cache.holding(set(words), lambda new: self.merger.merge([w.encode() for w in new])).__getitem__, [], 0
        for last in np.searchsorted(cuts, ends).tolist():  # the STOP after each text
            out.append(b"".join(map(at, words[first:last])))
            first = last + 1
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each id's bytes begin in the text, and the text's length."""
        return np.concatenate([[0], np.cumsum(self.sizes[ids])])

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        to = self.offsets(ids)
        return self.flat[np.repeat(self.starts[ids] - to[:-1], self.sizes[ids]) + np.arange(to[-1])].tobytes()


@lru_cache(maxsize=2)
def codec(ranks: bytes) -> ByteBpe:
    """One per Python worker, so that what a task has cached serves the next."""
    return ByteBpe(ranks)


def encode(df: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: id, ``ids`` (array, if ``with_ids``), ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    A map over the documents where they are read, without shuffle. Null text: as the empty text, no ids. Very long text:
    taken whole, a long pre-token merged with a heap. Null id: encoded like others. Repeated rows: each gives its row. Empty
    table: no rows. Other columns are not read.
    """
    raw = broadcast_file(df.sparkSession, ranks)

    def factory():
        bpe = codec(raw.value)

        def work(texts):
            packed = bpe.encode(texts)
            hashes = [[len(p) // 4 for p in packed], [hashlib.sha256(p).hexdigest() for p in packed], [hashlib.sha256(bpe.decode(p)).hexdigest() for p in packed]]
            return [[np.frombuffer(p, "<i4") for p in packed], *hashes] if with_ids else hashes

        return work

    kinds = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    return map_texts(df, [id_col, text_col], {id_col: "bigint"} | ({"ids": "array<int>"} if with_ids else {}) | kinds, factory)


def decode(df: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id and ``bytes``, the decoded ids. Null ids: null; no ids: no bytes. Very long lists: taken whole.
    Repeated rows and null ids of rows: each gives its row. Empty table: no rows. Other columns are not read."""
    raw = broadcast_file(df.sparkSession, ranks)

    @F.pandas_udf("binary")
    def back(ids):
        bpe = codec(raw.value)
        return ids.map(lambda x: None if x is None else bpe.decode(np.asarray(x, "<u4").tobytes()))

    return df.select(id_col, back(F.col(ids_col)).alias("bytes"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=False)
