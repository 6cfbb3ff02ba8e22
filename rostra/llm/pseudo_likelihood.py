"""Operator 9: document scores by masked pseudo-likelihood."""

from __future__ import annotations

from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from rostra.llm.common import map_texts, release_memory, slices, small_batches, table, written

#: A-Z in lower case; every other ASCII byte that is no digit or letter parts words.
FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20) for b in range(256))
#: The same, with a mark for each byte that ends a sentence.
MARK = b"\x01"
SENTENCES = bytes(MARK[0] if b in b".!?\n" else FOLD[b] for b in range(256))
#: Words that the network tells apart, the most frequent ones; it gives all others one id, and a chain over their bytes
#: goes on to the word.
VOCABULARY = 8192
RARE, PAD, SENTENCE = VOCABULARY, VOCABULARY + 1, VOCABULARY + 2
#: Words of a class: the first softmax gives the class, the second one the word.
WIDTH = 128
CLASSES = VOCABULARY // WIDTH + 1
SIDE, EMBED, HIDDEN = 2, 6, 16
BATCH, RATE = 8192, 0.04
#: Words that one copy of the network is trained on in a pass, about.
SHARD_WORDS = 3_000_000
#: Rounds of training: in each, one shard in so many takes part.
ROUNDS = (8, 1)
#: Rows that repeat id and text more often are dealt to shards by where they are stored, not together.
REPEATED = 1000
#: Numbers of a network that are averaged as one row.
BLOCK = 32
#: Distinct words that a worker keeps; fewer cost time only.
SEEN = 600_000
#: Sentences of fewer words are not looked up in the corpus.
RECALL_WORDS = 5


class Vocabulary:
    """The network's words with their corpus counts, and the byte chain of all other words.

    ``follows[a, b]``: how often byte b follows a in words beyond the network's, counted over the corpus; 0 (which no word
    holds) stands for a word's begin and end.
    """

    def __init__(self, counts: list[tuple[bytes, int]], rare: int = 0, follows: np.ndarray | None = None):
        self.ids = {w: i for i, (w, _) in enumerate(counts)}
        self.mass = np.zeros(VOCABULARY + 1)
        self.mass[: len(counts)] = [n for _, n in counts]
        self.mass[RARE] = rare
        chain = np.ones((256, 256)) if follows is None else follows + 1.0
        self.chain = np.log(chain / chain.sum(axis=1, keepdims=True))
        self.seen: dict[bytes, int] = {}
        self.table: tuple[np.ndarray, ...] = ()

    def spelled(self, words: list[bytes]) -> np.ndarray:
        """The log-probabilities of rare words among rare words."""
        x = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
        starts = np.flatnonzero(x == 0)[:-1]
        return np.add.reduceat(self.chain[x[:-1], x[1:]], starts) if len(starts) else np.zeros(0)

    def numbered(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' ids, 64-bit hashes, and log-probabilities within their id (0 but for rare words). Words are worked out once and kept."""
        found = np.fromiter(map(self.seen.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if not self.table or len(missing):
            new = list({words[i] for i in missing.tolist()})
            if not self.table or len(self.seen) + len(new) > len(self.table[0]):
                self.seen, new, missing = {}, list(set(words)), np.arange(len(words))
                size = max(SEEN, len(new))
                self.table = np.zeros(size, np.int32), np.zeros(size, np.uint64), np.zeros(size)
            at = slice(len(self.seen), len(self.seen) + len(new))
            ids = np.fromiter((SENTENCE if w == MARK else self.ids.get(w, RARE) for w in new), np.int32, len(new))
            self.table[0][at] = ids
            self.table[1][at] = np.fromiter(map(xxh3_64_intdigest, new), np.uint64, len(new))
            self.table[2][at] = np.where(ids == RARE, self.spelled(new), 0.0)
            self.seen.update(zip(new, range(at.start, at.stop), strict=True))
            found[missing] = np.fromiter((self.seen[words[i]] for i in missing.tolist()), np.int64, len(missing))
        return tuple(x[found] for x in self.table)


class WindowNet:
    """Predicts a word from SIDE words before and SIDE after it: embeddings, a hidden layer, a softmax over classes of WIDTH
    words of like frequency, and in the class a softmax over its words, which sees the hidden layer too.

    Places beyond a text's ends have the id PAD. Before training, biases give every word its share of the corpus.
    """

    def __init__(self, vocab: Vocabulary, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.3, (PAD + 1, EMBED)).astype(np.float32)
        self.w1 = rng.normal(0, (2 * SIDE * EMBED) ** -0.5, (2 * SIDE * EMBED, HIDDEN)).astype(np.float32)
        self.b1 = np.zeros(HIDDEN, np.float32)
        # the last column holds biases
        self.w2 = np.zeros((CLASSES, HIDDEN + 1), np.float32)
        self.w3 = np.zeros((VOCABULARY, HIDDEN + 1), np.float32)
        known = vocab.mass[:VOCABULARY].reshape(-1, WIDTH)
        by_class = np.append(known.sum(axis=1), vocab.mass[RARE]) + 0.1
        self.w2[:, -1] = np.log(by_class / by_class.sum())
        self.w3[:, -1] = np.log((known + 1e-6) / (known + 1e-6).sum(axis=1, keepdims=True)).ravel()

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.w1, self.b1, self.w2, self.w3]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params()])

    def load(self, flat: np.ndarray) -> WindowNet:
        at = 0
        for p in self.params():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    @staticmethod
    def contexts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Every word's neighbours, and the words."""
        gap = np.full(SIDE, PAD, np.int32)
        held = np.concatenate([x for t in texts for x in (gap, t)] + [gap])
        at = np.flatnonzero(held != PAD)
        return held[at[:, None] + np.array([k for k in range(-SIDE, SIDE + 1) if k])], held[at]

    def hidden(self, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the hidden layer reads, and what it gives, with a column of ones for biases."""
        x = self.embed.take(ctx, axis=0).reshape(len(ctx), -1)
        h = np.ones((len(ctx), HIDDEN + 1), np.float32)
        np.maximum(x @ self.w1 + self.b1, 0, out=h[:, :-1])
        return x, h

    @staticmethod
    def exponentials(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A softmax before division: exponentials and their sums by row."""
        z = h @ w.T
        e = np.exp(z)
        total = e @ np.ones(e.shape[1], np.float32)
        if not (total.min() > 1e-30 and total.max() < 1e30):  # too far off for plain exponentials
            e = np.exp(z - z.max(axis=1, keepdims=True))
            total = e.sum(axis=1)
        return e, total

    @staticmethod
    def by_class(own: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order of the words by class, and (class, begin, end) of the classes in it; the rare words, which come last, have no entry."""
        kind = (own // WIDTH).astype(np.uint8)
        order = np.argsort(kind, kind="stable")
        ends = np.cumsum(np.bincount(kind, minlength=CLASSES)).tolist()
        return order, [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends], ends[: CLASSES - 1])) if b > a]

    def log_probabilities(self, ctx: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Of the words, or of the id of all rare words, given what stands around them."""
        order, spans = self.by_class(own)
        word, row = own[order], np.arange(len(own))
        _, h = self.hidden(ctx[order])
        e, total = self.exponentials(h, self.w2)
        p = e[row, word // WIDTH] / total
        for c, a, b in spans:
            e, total = self.exponentials(h[a:b], self.w3[c * WIDTH : (c + 1) * WIDTH])
            p[a:b] *= e[row[: b - a], word[a:b] - c * WIDTH] / total
        out = np.empty(len(own))
        out[order] = np.log(np.maximum(p, 1e-30))
        return out

    def errors(self, h: np.ndarray, w: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """The softmax less what is right, as a share of n words."""
        e, total = self.exponentials(h, w)
        e *= (1 / (total * n))[:, None]
        e[np.arange(len(at)), at] -= np.float32(1 / n)
        return e

    def learn(self, ctx: np.ndarray, own: np.ndarray, state: list[np.ndarray]) -> None:
        """One Adagrad step on the mean cross entropy."""
        order, spans = self.by_class(own)
        ctx, own, n = ctx[order], own[order], len(own)
        x, h = self.hidden(ctx)
        p = self.errors(h, self.w2, own // WIDTH, n)
        gh = p @ self.w2[:, :-1]
        for c, a, b in spans:
            w = self.w3[c * WIDTH : (c + 1) * WIDTH]
            q = self.errors(h[a:b], w, own[a:b] - c * WIDTH, n)
            gh[a:b] += q @ w[:, :-1]
            self.step(w, q.T @ h[a:b], state[4][c * WIDTH : (c + 1) * WIDTH])
        gh *= h[:, :-1] > 0
        gx = (gh @ self.w1.T).reshape(-1, EMBED)
        at = ctx.ravel()
        ge = np.stack([np.bincount(at, gx[:, k], PAD + 1) for k in range(EMBED)], axis=1).astype(np.float32)
        for q, g, held in zip(self.params(), (ge, x.T @ gh, gh.sum(axis=0), p.T @ h), state):
            self.step(q, g, held)

    @staticmethod
    def step(q: np.ndarray, g: np.ndarray, held: np.ndarray) -> None:
        held += g * g
        g *= RATE
        g /= np.sqrt(held) + 1e-6
        q -= g

    def fit(self, texts, state: list[np.ndarray] | None = None) -> int:
        """A pass over texts (arrays of ids) in batches of about BATCH words; the number of words."""
        state = [np.zeros_like(p) for p in self.params()] if state is None else state
        held, size, seen = [], 0, 0

        def pass_over():
            ctx, own = self.contexts(held)
            cuts = np.linspace(0, len(own), max(1, round(len(own) / BATCH)) + 1).astype(int).tolist()
            for a, b in zip(cuts, cuts[1:]):  # one step, or several of one size after a long text
                self.learn(ctx[a:b], own[a:b], state)
            return len(own)

        for t in texts:
            held.append(t)
            size += len(t)
            if size >= BATCH:
                seen, held, size = seen + pass_over(), [], 0
        return seen + (pass_over() if size else 0)


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts. Each task adds up what it reads before anything is shuffled; its table is bounded and is given out when full."""

    def run(batches):
        counts: Counter[bytes] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in slices(batch, 0):
                for text in part.column(0).to_pylist():
                    counts.update((text or "").encode().translate(FOLD).split())
                if len(counts) > 200_000:
                    yield out()
                    counts.clear()
        yield out()
        counts.clear()
        release_memory()

    small_batches(df.sparkSession)
    return df.select(text_col).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(df: DataFrame, text_col: str = "text") -> Vocabulary:
    """The VOCABULARY most frequent words (ties: smaller first), and the byte pairs of all others; both are bounded tables, which come to the driver."""
    counts = written(word_counts(df, text_col))
    # a histogram of the counts' sizes tells above which the most frequent words lie, so that tasks send few others
    size = F.floor(F.log2("n") * 8).cast("int")
    least, held = 0, 0
    for b, n in sorted(((r.b, r.c) for r in counts.groupBy(size.alias("b")).agg(F.count("*").alias("c")).collect()), reverse=True):
        least, held = b, held + n
        if held >= VOCABULARY:
            break
    top = [(bytes(r.word), r.n) for r in counts.where(size >= least).orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()]
    known = counts.sparkSession.sparkContext.broadcast(frozenset(w for w, _ in top))

    def pairs(batches):
        sums, rare = np.zeros(65536, np.int64), 0
        for batch in batches:
            kept = [(w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if w not in known.value]
            if kept:
                x = np.frombuffer(b"\0" + b"\0".join(w for w, _ in kept) + b"\0", np.uint8).astype(np.int64)
                sums += np.bincount(x[:-1] * 256 + x[1:], np.repeat([n for _, n in kept], [len(w) + 1 for w, _ in kept]), 65536).astype(np.int64)
                rare += sum(n for _, n in kept)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(sums[at], rare))], names=["pair", "n"])

    follows, rare = np.zeros(65536, np.int64), 0
    for r in counts.select("word", "n").mapInArrow(pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        if r.pair < 0:
            rare = r.n
        else:
            follows[r.pair] = r.n
    return Vocabulary(top, rare, follows.reshape(256, 256))


def encoded(df: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, ids, sizes, keys, spelled), written: a text's word ids as 16-bit integers, and of each of its sentences the
    number of words, the hash of the words, and the log-probability of its rare words within their id."""
    held = df.sparkSession.sparkContext.broadcast(vocab)

    def factory():
        odd = np.uint64(0x9E3779B97F4A7C15)
        powers = np.cumprod(np.full(1 << 16, odd))

        def work(texts):
            v, out = held.value, [[], [], [], []]
            for s in range(0, len(texts), 64):
                split = [(t or "").encode().translate(SENTENCES).replace(MARK, b" \x01 ").split() for t in texts[s : s + 64]]
                upto = np.cumsum([len(x) for x in split])
                ids, hashes, spelled = v.numbered([*chain.from_iterable(split)])
                mark = ids == SENTENCE
                # a sentence begins after a mark and with a text
                begin = np.cumsum(mark)
                begin += np.searchsorted(upto, np.arange(len(ids)), side="right")
                ids, hashes, spelled, begin = (x[~mark] for x in (ids, hashes, spelled, begin))
                words = upto - np.concatenate([[0], np.cumsum(mark)])[upto]
                starts = np.flatnonzero(np.diff(begin, prepend=-1))
                sizes = np.diff(starts, append=len(ids))
                place = np.arange(len(ids)) - np.repeat(starts, sizes)
                mixed = (hashes ^ (hashes >> np.uint64(29))) * powers[place & 0xFFFF]
                keys = (np.add.reduceat(mixed, starts) if len(starts) else mixed[:0]) * odd
                keys = (keys ^ (keys >> np.uint64(32))).view(np.int64)
                rare = np.add.reduceat(spelled, starts) if len(starts) else spelled
                packed, at = ids.astype("<u2"), np.searchsorted(starts, words)
                for a, b, i, j in zip([0, *words[:-1].tolist()], words.tolist(), [0, *at[:-1].tolist()], at.tolist(), strict=True):
                    for column, x in zip(out, (packed[a:b].tobytes(), sizes[i:j].astype("<i4"), keys[i:j], rare[i:j]), strict=True):
                        column.append(x)
            return out

        return work

    rows = map_texts(df, [id_col, text_col], {"id": "bigint", "ids": "binary", "sizes": "array<int>", "keys": "array<bigint>", "spelled": "array<double>"}, factory)
    # rows are numbered when written, so both sides of later joins have the same numbers
    return written(rows.withColumn("row", F.monotonically_increasing_id()))


def train(texts: DataFrame, vocab: Vocabulary, shard_words: int = SHARD_WORDS, rounds: tuple[int, ...] = ROUNDS) -> WindowNet:
    """A network trained on every word of the encoded texts.

    Texts are dealt by hash into as many shards as the corpus has ``shard_words``, in the order of their hashes, however
    they were stored; a text that stands REPEATED times and more under one id is spread over all. For each shard, which is
    a few MB, a copy of the network passes over its texts; what it has moved by is averaged over all shards, weighted by
    words. Averages are made in Spark, BLOCK numbers to a row, so the driver gets one network.

    Each round starts from the last one's average. Its number n says that one shard in n takes part; the last one is 1.
    """
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast(vocab)
    columns = [f"d{k}" for k in range(BLOCK)]
    rows = texts.where(F.length("ids") > 0).select(F.xxhash64("id", "ids").alias("h"), "row", "ids")
    words = int(rows.agg(F.sum(F.length("ids") / 2)).head()[0] or 0)
    often = rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > REPEATED).select("h")
    if often.head(1):
        again = rows.join(often, "h", "left_semi").select(F.xxhash64("h", "row").alias("h"), "row", "ids")
        rows = rows.join(often, "h", "left_anti").unionByName(again)
    number = max(1, -(-words // shard_words))
    dealt = rows.select(F.pmod("h", F.lit(number)).alias("shard"), "h", "ids")

    def moving(start):
        def run(shard: pa.Table) -> pa.Table:
            net, first = WindowNet(held.value).load(start.value), start.value
            seen = net.fit(np.frombuffer(x.as_py(), "<u2").astype(np.int32) for x in shard.column("ids").take(pc.sort_indices(shard.column("h"))))
            moved = (net.flat() - first) * np.float32(seen)
            moved = np.pad(moved, (0, -len(moved) % BLOCK)).reshape(-1, BLOCK)
            at = np.flatnonzero(moved.any(axis=1))
            blocks = [pa.array(np.append(x, seen if k == 0 else 0).astype(np.float64)) for k, x in enumerate(moved[at].T)]
            return pa.Table.from_arrays([pa.array(np.append(at, -1), pa.int64()), *blocks], names=["i", *columns])  # -1: the number of words

        return run

    net = WindowNet(vocab)
    for every in rounds:
        if every > 1 and number == 1:
            continue  # one shard has nobody to agree with
        start = spark.sparkContext.broadcast(net.flat())

        part = dealt.where(F.col("shard") % every == 0)
        moves = part.groupBy("shard").applyInArrow(moving(start), "i bigint, " + ", ".join(f"{c} double" for c in columns)).groupBy("i").agg(*[F.sum(c).alias(c) for c in columns])
        flat, got = net.flat(), moves.toArrow()
        whole = np.pad(flat.astype(np.float64), (0, -len(flat) % BLOCK)).reshape(-1, BLOCK)
        at, sums = got["i"].to_numpy(), np.stack([got[c].to_numpy() for c in columns], axis=1)
        seen = sums[at < 0, 0].sum()
        if seen:
            whole[at[at >= 0]] += sums[at >= 0] / seen
        net.load(whole.ravel()[: len(flat)].astype(np.float32))
        start.unpersist()
    return net


def sentence_scores(texts: DataFrame, net: WindowNet) -> DataFrame:
    """(row, id, n_tokens, pll, parts), written: parts are (key, size, log-probability) of sentences long enough to be looked up."""
    held = texts.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = held.value
        for whole in batches:
            for s in range(0, whole.num_rows, 64):
                b = whole.slice(s, 64)
                ids = [np.frombuffer(x.as_py(), "<u2").astype(np.int32) for x in b.column(2)]
                n = np.array([len(x) for x in ids], np.int64)
                ctx, own = net.contexts(ids)
                logs = np.concatenate([net.log_probabilities(ctx[k : k + BATCH], own[k : k + BATCH]) for k in range(0, len(own), BATCH)] or [np.zeros(0)])
                sizes, keys, spelled = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (3, 4, 5))
                per = np.array([len(x) for x in b.column(3)], np.int64)
                total = np.concatenate([[0.0], np.cumsum(logs)])
                ends = np.cumsum(sizes)
                sums = total[ends] - total[ends - sizes] + spelled
                upto, last = np.concatenate([[0.0], np.cumsum(sums)]), np.cumsum(per)
                long = sizes >= RECALL_WORDS
                offsets = np.concatenate([[0], np.cumsum(long)])[np.concatenate([[0], last])]
                parts = pa.StructArray.from_arrays([pa.array(keys[long]), pa.array(sizes[long], pa.int32()), pa.array(sums[long])], names=["key", "size", "logp"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(n), pa.array(upto[last] - upto[last - per]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)],
                    names=["row", "id", "n_tokens", "pll", "parts"],
                )
        release_memory()

    small_batches(texts.sparkSession)
    rows = texts.select("row", "id", "ids", "sizes", "keys", "spelled")
    return written(rows.mapInArrow(run, "row bigint, id bigint, n_tokens bigint, pll double, parts array<struct<key:bigint,size:int,logp:double>>"))


def score(texts: DataFrame, net: WindowNet, id_col: str = "doc_id") -> DataFrame:
    """One row per encoded text: id, ``n_tokens``, ``pll``, ``mean_pll``, ``n_recalled``, ``corpus_pll``, ``mean_corpus_pll``.

    ``pll`` sums the log-probabilities of every word given the words around it: the network's class, word in the class, and
    for rare words their bytes. ``corpus_pll`` lets the corpus help: a sentence of RECALL_WORDS words or more that stands in
    c other places of the corpus has (c + p) / (c + 1) in place of its words' p. ``n_recalled`` counts the words of such
    sentences. Means are by word, 0 without words.
    """
    scored = sentence_scores(texts, net)
    part = scored.select("row", F.explode("parts").alias("x")).select("row", "x.key", "x.size", "x.logp")
    # sentences of one place only, nearly all, meet nothing in the join
    counts = part.groupBy("key").agg((F.count("*") - 1).alias("c")).where("c > 0")
    gain = F.log((F.col("c") + F.exp("logp")) / (F.col("c") + 1)) - F.col("logp")
    more = part.join(counts, "key").groupBy("row").agg(F.sum("size").alias("n"), F.sum(gain).alias("gain"))
    zero = F.lit(0.0)
    corpus = F.col("pll") + F.coalesce("gain", zero)
    mean = lambda x: F.when(F.col("n_tokens") > 0, x / F.col("n_tokens")).otherwise(0.0)
    return scored.drop("parts").join(more, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", "pll", mean(F.col("pll")).alias("mean_pll"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_recalled"), corpus.alias("corpus_pll"), mean(corpus).alias("mean_corpus_pll")
    )


def pseudo_likelihood(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` of all rows by a network trained on the same rows.

    Word counts, byte pairs, training and sentence counts cover every word of every text; word and sentence counts grow with
    the corpus and stay in Spark. What is broadcast is bounded by VOCABULARY: words, byte pairs, the network.

    Null, empty or wordless text: 0 words, 0. Very long text: all its words, in slices. Null id: scored like others. Repeated
    rows: each gives its row, and counts. Ties in frequency: smaller words first. Empty table: no rows. Other columns are
    not read.
    """
    vocab = vocabulary(df, text_col)
    texts = encoded(df, vocab, id_col, text_col)
    return score(texts, train(texts, vocab), id_col)


def op9_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))
