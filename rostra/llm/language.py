"""Operator 4: language identification with a convolutional network over bytes, trained in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostra.llm.common import batch_map, map_texts, slices, table

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Places in a window at which every filter is applied.
PLACES = WINDOW - max(WIDTHS) + 1
EMBED = 6
#: Labelled rows of each language that are fitted on, at most.
SAMPLE_ROWS = 400
#: Windows of one text that are fitted on, and languages, at most.
MOST_WINDOWS, MOST_LANGS = 512, 1_000
#: Windows that are scored at a time.
SCORED = 2048


class ByteCnn:
    """Bytes -> embedding -> filters of several widths -> max over a window -> softmax over languages.

    Windows have WINDOW bytes; the last one of a text is filled up with zeros. A text's scores are the mean of its
    windows' log-probabilities, weighted by their bytes.
    """

    def __init__(self, langs: list[str], seed: int = 7):
        rng, n = np.random.default_rng(seed), len(WIDTHS) * FILTERS
        self.langs = langs
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = [rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def windows(self, raw: bytes) -> np.ndarray:
        rows = max(1, -(-len(raw) // WINDOW))
        return np.frombuffer(raw.ljust(rows * WINDOW, b"\0"), np.uint8).reshape(rows, WINDOW)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Max of each filter over the window, and where it is taken."""
        best, where = [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            tables = self.embed @ f  # w tables of a filter's response to each byte
            total = tables[0][x[:, :PLACES]]
            for k in range(1, w):
                total += tables[k][x[:, k : PLACES + k]]
            at = total.argmax(axis=1)
            where.append(at)
            best.append(np.take_along_axis(total, at[:, None], axis=1)[:, 0])
        return np.concatenate(best, axis=1) + self.bias, where

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """All filters' responses to a pair of bytes at a place and to the pair two bytes on; their sum is the convolution."""
        one = np.zeros((4, 256, len(WIDTHS) * FILTERS), np.float32)  # by tap; narrower filters have fewer
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            one[:w, :, k * FILTERS : (k + 1) * FILTERS] = self.embed @ f
        return tuple((one[k][:, None] + one[k + 1][None]).reshape(65536, -1) for k in (0, 2))

    def logits(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        best = np.empty((len(x), tables[0].shape[1]), np.float32)
        for s in range(0, len(x), 64):  # small enough for the processor's cache
            part = x[s : s + 64, :-1].astype(np.intp) * 256 + x[s : s + 64, 1:]
            total = tables[0].take(part[:, :PLACES], axis=0)
            total += tables[1].take(part[:, 2 : PLACES + 2], axis=0)
            total.max(axis=1, out=best[s : s + 64])
        return np.maximum(best + self.bias, 0) @ self.out + self.out_bias

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 2, batch: int = 64, rate: float = 0.004, seed: int = 11) -> None:
        """Adam on the cross entropy, classes weighted to count alike."""
        rng = np.random.default_rng(seed)
        weight = len(y) / (len(self.langs) * np.maximum(np.bincount(y, minlength=len(self.langs)), 1))
        params = [self.embed, *self.filters, self.bias, self.out, self.out_bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(order), batch):
                at = order[s : s + batch]
                xs, ys = x[at], y[at]
                pre, where = self.pooled(xs)
                act = np.maximum(pre, 0)
                z = act @ self.out + self.out_bias
                z -= z.max(axis=1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(ys)), ys] -= 1
                p *= (weight[ys] / len(ys))[:, None]
                p = p.astype(np.float32)
                back = (p @ self.out.T) * (pre > 0)
                g_embed, g_filters = np.zeros_like(self.embed), []
                for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                    g = back[:, k * FILTERS : (k + 1) * FILTERS]
                    gf = np.zeros_like(f)
                    for j in range(w):
                        b = np.take_along_axis(xs, where[k] + j, axis=1)  # the byte under tap j of each filter's best place
                        gf[j] = np.einsum("bf,bfe->ef", g, self.embed[b])
                        np.add.at(g_embed, b.ravel(), (g[:, :, None] * f[j].T[None]).reshape(-1, EMBED))
                    g_filters.append(gf)
                grads = [g_embed, *g_filters, back.sum(axis=0), act.T @ p, p.sum(axis=0)]
                t += 1
                for q, g, a, b in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    def predict(self, texts: list[str | None], tables=None) -> list[tuple[str, float]]:
        tables, out = tables or self.tables(), []
        for t in texts:
            raw = t.encode() if t and LETTER.search(t) else b""
            if not raw:
                out.append((UNKNOWN, 0.0))
                continue
            total, windows = np.zeros(len(self.langs)), self.windows(raw)
            for s in range(0, len(windows), SCORED):
                x = windows[s : s + SCORED]
                z = self.logits(x, tables).astype(np.float64)
                z -= z.max(axis=1, keepdims=True)
                z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
                total += (x != 0).sum(axis=1) @ z
            prob = np.exp((total - total.max()) / len(raw))
            best = int(prob.argmax())
            out.append((self.langs[best], float(prob[best] / prob.sum())))
        return out


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> ByteCnn | None:
    """A network fitted on at most ``rows`` labelled rows of each language: those with the smallest hashes of id and text. None if no row is labelled.

    Every window of a text is fitted on; of a text with more than MOST_WINDOWS so many, evenly spread over it. Windows are cut
    in tasks, so the driver gets at most ``rows`` * MOST_WINDOWS * WINDOW bytes a language, and raises ValueError for more
    than MOST_LANGS languages. Languages rarer than ``rows`` are taken whole. Rows without label, text or letters are not
    fitted on. Rows that repeat id and text count once.
    """
    text, h = F.col(text_col), F.xxhash64(id_col, text_col)
    named = df.where(F.col(lang_col).isNotNull() & text.rlike(r"\p{L}"))
    counts = named.groupBy(F.col(lang_col).alias("lang")).count().limit(MOST_LANGS + 1).collect()  # a row for each language
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not counts:
        return None
    # each task passes on only rows with small hashes, some more in all than are kept, and repeated ones once
    most = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(int(min(2**63 - 1, -(2**63) + 4.0 * rows / r["count"] * 2**64))).cast("bigint"))])
    some = named.select(F.col(lang_col).alias("lang"), h.alias("h"), text.alias("text")).where(F.col("h") <= most[F.col("lang")]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    order = W.partitionBy("lang").orderBy("h")
    chosen = some.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows).select("lang", "n", "text")
    langs = sorted({r["lang"] for r in counts})
    net = ByteCnn(langs)

    def cut(batches):
        for batch in batches:
            for part in slices(batch, 2):
                found = []
                for t in part.column(2).to_pylist():
                    x = net.windows(t.encode())
                    found.append((x if len(x) <= MOST_WINDOWS else x[np.linspace(0, len(x) - 1, MOST_WINDOWS).astype(int)]).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], names=["lang", "n", "windows"])

    sample = sorted(chosen.mapInArrow(cut, "lang string, n int, windows binary").collect(), key=lambda r: (r.lang, r.n))
    parts = [np.frombuffer(r.windows, np.uint8).reshape(-1, WINDOW) for r in sample]
    net.fit(np.concatenate(parts), np.repeat([langs.index(r.lang) for r in sample], [len(p) for p in parts]))
    return net


def identify(df: DataFrame, net: ByteCnn | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``lang_pred``, ``score`` (0 to 1).

    Every window of the whole text is scored, in batches, where the documents are read: no shuffle. The network has a
    fixed size and is broadcast. Null, empty or letterless text, or no network: ``und``, 0. Very long text: all its
    windows, some at a time. Null id: like others. Repeated rows: each gives its row. Ties: the smaller language. Empty
    table: no rows. Other columns are not read.
    """
    held = df.sparkSession.sparkContext.broadcast(net)

    def factory():
        tables = held.value.tables() if held.value else None

        def work(texts):
            got = held.value.predict(texts, tables) if held.value else [(UNKNOWN, 0.0)] * len(texts)
            return [[x[0] for x in got], [min(1.0, max(0.0, x[1])) for x in got]]

        return work

    return map_texts(df, [id_col, text_col], {id_col: "bigint", "lang_pred": "string", "score": "double"}, factory)


def accepted(df: DataFrame, net: ByteCnn | None, text_col: str = "text", least_margin: float = 0.1) -> DataFrame:
    """The rows of ``df`` whose text is in a recognised language; all columns stay as they are.

    With n languages a score is 1 / n at least; it must be ``least_margin`` of the way from there to 1. Rows are judged where
    they are read and passed on, so no text is shuffled. Null, empty or letterless texts go, and all rows if there is no
    network. Very long text: all its windows. Null ids, repeated rows: each row is judged by its text. Empty table: no rows.
    """
    least_score = least_margin + (1 - least_margin) / max(1, len(net.langs) if net else 1)
    held = df.sparkSession.sparkContext.broadcast(net)
    place = df.columns.index(text_col)

    def factory():
        tables = held.value.tables() if held.value else None

        def work(whole):
            for part in slices(whole, place):
                texts = part.column(place).to_pylist()
                got = held.value.predict(texts, tables) if held.value else [(UNKNOWN, 0.0)] * len(texts)
                yield part.filter(pa.array([lang != UNKNOWN and (len(held.value.langs) == 1 or score >= least_score) for lang, score in got], pa.bool_()))

        return work

    return batch_map(df, factory, df.schema)


def held_out(id_col: str = "doc_id"):
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4) == 2


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``held_out`` of a row without id is null; such rows are not learned from."""
    docs = table(spark, sf_dir, "documents")
    net = train(docs.where(~held_out()))
    return identify(docs, net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
