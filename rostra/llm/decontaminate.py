"""Operator 7: benchmark decontamination with a generalised suffix automaton over words."""

from __future__ import annotations

import hashlib
import pickle
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostra.llm.common import batch_map, map_texts, slices, table, unused, written

#: A-Z in lower case; every other ASCII byte that is neither a digit nor a-z parts words.
FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20) for b in range(256))
#: UTF-8 bytes of items in one automaton, about; more items go to more automata.
SHARD_BYTES = 4 << 20
#: Longer items are cut into pieces of so many words, which overlap so that every window lies in one.
LONG_BYTES, PIECE_WORDS = 1 << 20, 100_000
#: Pickled automata that are broadcast together, for one pass over the documents; one alone may have MOST_BYTES.
PASS_BYTES, MOST_BYTES = 64 << 20, 256 << 20


def words(text: str | None) -> list[bytes]:
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case."""
    return (text or "").encode().translate(FOLD).split()


class SuffixAutomaton:
    """All word sequences that occur in test items.

    ``window``: items of fewer words are one window as a whole, others have every run of so many words as a window.

    States are places in flat integer arrays. Most states go on by one word only, which stands in ``word`` and ``to``; further
    ways of the few that part stand in ``more``.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window, self.number = window, {}
        self.word, self.to, self.link, self.size = array("i", [-1]), array("i", [0]), array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        self.names = [name for name, _ in items]
        number, numbered = self.number, []
        for _, item in items:
            last, ids = 0, array("i", [number.setdefault(w, len(number)) for w in item])
            numbered.append(ids)
            for w in ids:
                last = self.extend(last, w)
        #: By state: the items of which the last ``window`` words are a window (one number, or several).
        self.items: dict[int, int | tuple[int, ...]] = {}
        #: By state: (length, item) of the short items that end here.
        self.short: dict[int, list[tuple[int, int]]] = {}
        for k, ids in enumerate(numbered):
            if 0 < len(ids) < window:
                s = 0
                for w in ids:
                    s = self.step(s, w)
                self.short.setdefault(s, []).append((len(ids), k))
                continue
            s = n = 0
            for w in ids:
                s, n = self.step(s, w), n + 1
                if n >= window:
                    while self.size[self.link[s]] >= window:  # the state of the last words alone
                        s = self.link[s]
                    self.note(s, k)
        self.ends = self.short_ends()
        self.least = min([window, *(len(ids) for ids in numbered if len(ids))])

    def note(self, s: int, k: int) -> None:
        held = self.items.get(s)
        if held is None:
            self.items[s] = k
        elif (held[-1] if isinstance(held, tuple) else held) != k:  # items come in order
            self.items[s] = (*held, k) if isinstance(held, tuple) else (held, k)

    def short_ends(self) -> array:
        """Of each state the nearest one with short items along its suffix links, itself included, or 0."""
        out = array("i", bytes(4 * len(self.link)))
        if self.short:
            for s in np.argsort(np.frombuffer(self.size, np.int32), kind="stable").tolist():
                if s:
                    out[s] = s if s in self.short else out[self.link[s]]
        return out

    def step(self, s: int, w: int) -> int:
        """The next state, or -1."""
        if self.word[s] == w:
            return self.to[s]
        return self.more[s].get(w, -1) if s in self.more else -1

    def put(self, s: int, w: int, to: int) -> None:
        if self.word[s] == w or self.word[s] == -1:
            self.word[s], self.to[s] = w, to
        else:
            self.more.setdefault(s, {})[w] = to

    def extend(self, last: int, w: int) -> int:
        if (q := self.step(last, w)) >= 0:  # another item went this way
            return q if self.size[q] == self.size[last] + 1 else self.clone(last, w, q)
        new = self.state(self.size[last] + 1, 0)
        p = last
        while p != -1 and self.step(p, w) < 0:
            self.put(p, w, new)
            p = self.link[p]
        if p != -1:
            q = self.step(p, w)
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self.clone(p, w, q)
        return new

    def state(self, size: int, link: int) -> int:
        for column, x in ((self.word, -1), (self.to, 0), (self.size, size), (self.link, link)):
            column.append(x)
        return len(self.link) - 1

    def clone(self, p: int, w: int, q: int) -> int:
        c = self.state(self.size[p] + 1, self.link[q])
        self.word[c], self.to[c] = self.word[q], self.to[q]
        if q in self.more:
            self.more[c] = dict(self.more[q])
        self.link[q] = c
        while p != -1 and self.step(p, w) == q:
            self.put(p, w, c)
            p = self.link[p]
        return c

    def matches(self, text: list[bytes], whole: set[tuple[int, int]] | None = None) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words inside occurrences of windows, merged, in order; the items that have these windows. Where whole short
        items stand is put into ``whole``.

        Words that no item has end every match, so only runs of known words are streamed.
        """
        ids = np.fromiter(map(self.number.get, text, [-1] * len(text)), np.int64, len(text))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ids >= 0, [0]])))
        spans, found = [], set()
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= self.least:
                self.stream(ids[a:b].tolist(), a, spans, found, whole)
        return spans, found

    def stream(self, ids: list[int], at: int, spans: list, found: set, whole: set | None) -> None:
        word, to, more, link, size, items, ends, window = self.word, self.to, self.more, self.link, self.size, self.items, self.ends, self.window
        state = length = 0
        for i, w in enumerate(ids, at + 1):
            while True:
                if word[state] == w:
                    state, length = to[state], length + 1
                    break
                if state in more and w in more[state]:
                    state, length = more[state][w], length + 1
                    break
                if not state:
                    break
                state = link[state]
                length = size[state]
            if length >= window:
                # the state of the last words alone: what is longer finds nothing more, and a match never climbs twice
                while size[link[state]] >= window:
                    state = link[state]
                length = window
                if (k := items.get(state)) is not None:
                    found.update(k) if isinstance(k, tuple) else found.add(k)
                    self.add(spans, i - window, i)
            t = ends[state]
            while t:
                for n, k in self.short[t]:
                    if n <= length:
                        found.add(k)
                        self.add(spans, i - n, i)
                        if whole is not None:
                            whole.add((i - n, i))
                t = ends[link[t]]

    @staticmethod
    def add(spans: list, a: int, b: int) -> None:
        while spans and spans[-1][1] >= a:
            a = min(a, spans.pop()[0])
        spans.append((a, b))


class Several:
    """Automata that are asked together."""

    def __init__(self, automata: list[SuffixAutomaton]):
        self.automata = automata

    def matches(self, text: list[bytes], whole: set[tuple[int, int]] | None = None) -> tuple[list[tuple[int, int]], list[str | None]]:
        """Merged spans, and the names of items."""
        every, names = [], []
        for a in self.automata:
            spans, found = a.matches(text, whole)
            every += spans
            names += [a.names[k] for k in found]
        return merged_spans(every) if len(self.automata) > 1 else every, names


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list = []
    for s in sorted(spans):
        SuffixAutomaton.add(out, *s)
    return out


def pieces(rows: DataFrame, window: int) -> DataFrame:
    """(name, text) with very long texts in pieces of the same name."""

    def work(batch: pa.RecordBatch):
        for part in slices(batch, 1):
            names, texts = [], []
            for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                cut = [text]
                if len(text) > LONG_BYTES // 4 and len(text.encode()) > LONG_BYTES and len(w := words(text)) > PIECE_WORDS:
                    cut = [b" ".join(w[i : i + PIECE_WORDS + window - 1]).decode() for i in range(0, len(w) - window + 1, PIECE_WORDS)]
                names += [name] * len(cut)
                texts += cut
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["name", "text"])

    return batch_map(rows, lambda: work, "name string, text string")


def automata(items: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Broadcast]:
    """Automata of items dealt by hash into shards of about SHARD_BYTES, broadcast in groups of about PASS_BYTES, one group after another.

    Each is made by a task, once, and comes through the driver with its group; so neither holds the whole benchmark. One
    beyond MOST_BYTES raises ValueError.
    """
    spark = items.sparkSession
    rows = items.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text")).where("text is not null").distinct()
    rows = written(pieces(rows, window))
    held = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    number = max(1, -(-held // SHARD_BYTES))

    def make(shard: pa.Table) -> pa.Table:
        made = SuffixAutomaton([(n, words(t)) for n, t in zip(shard.column("name").to_pylist(), shard.column("text").to_pylist(), strict=True)], window)
        return pa.table({"automaton": pa.array([pickle.dumps(made)], pa.binary())})

    made = rows.withColumn("shard", F.pmod(F.xxhash64("name", "text"), F.lit(number))).groupBy("shard").applyInArrow(make, "automaton binary")
    group, size = [], 0
    for row in written(made).toLocalIterator():
        if (n := len(row.automaton)) > MOST_BYTES:
            raise ValueError(f"an automaton of {n} bytes is not broadcast; lower SHARD_BYTES")
        if group and size + n > PASS_BYTES:
            yield spark.sparkContext.broadcast(Several(group))
            group, size = [], 0
        group.append(pickle.loads(row.automaton))
        size += n
    if group:
        yield spark.sparkContext.broadcast(Several(group))


def hits(df: DataFrame, automaton: Broadcast | None, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, ``n_words``, ``text_md5``, ``spans``, ``items``."""

    def factory():
        a = automaton.value if automaton else None

        def work(texts):
            out = [[], [], [], []]
            for text in texts:
                tokens = words(text)
                spans, found = a.matches(tokens) if a else ([], ())
                row = (len(tokens), hashlib.md5(text.encode()).digest() if text else b"", [x for s in spans for x in s], list(found))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            return out

        return work

    return map_texts(df, [id_col, text_col], {id_col: "bigint", "n_words": "bigint", "text_md5": "binary", "spans": "array<int>", "items": "array<string>"}, factory)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def merged(spans):
    """Spans of several automata, in order and merged."""

    def one(x):
        return [y for s in merged_spans([*zip(x[::2].tolist(), x[1::2].tolist(), strict=True)]) for y in s]

    return spans.map(one)


def all_hits(df: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, window: int) -> DataFrame:
    """``hits`` of all automata together. One group of them: a map. Of further ones, hits alone are kept and are joined by text."""
    found, rest = None, None
    for one in automata(items, item_id, item_text, window):
        if found is None:
            found = hits(df, one, id_col, text_col)
            continue
        if rest is None:
            found = written(found)
        more = written(hits(df, one, id_col, text_col).where(F.size("spans") > 0).select("text_md5", "spans", "items").dropDuplicates(["text_md5"]))
        rest = more if rest is None else rest.union(more)
        one.unpersist()
    if found is None or rest is None:
        return hits(df, None, id_col, text_col) if found is None else found
    more = rest.groupBy("text_md5").agg(F.flatten(F.collect_list("spans")).alias("more"), F.flatten(F.collect_list("items")).alias("named"))
    both = found.join(more, "text_md5", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return both.select(
        id_col, "n_words", "text_md5", merged(F.concat("spans", empty("more", "array<int>"))).alias("spans"), F.array_distinct(F.concat("items", empty("named", "array<string>"))).alias("items")
    )


def find_contamination(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``spans`` (array of first word, end, first word, end ...), ``contaminated``.

    Documents stream through the automata where they are read, in time linear in their words: no shuffle, unless the
    benchmark has more than about PASS_BYTES of automata, which then take their turns. A very long item is held in pieces.

    Null, empty or wordless text: 0 words, clean. Very long text: taken whole, one state of the automaton at a time. Null id:
    like others. Repeated documents: each gives its row. Repeated items: all are counted; rows of one item id count once.
    Items without id: their windows count, together as one item, which the hash leaves out. Items without words: no window.
    Empty benchmark: all clean. Other columns are not read.
    """
    found = all_hits(df, items, id_col, text_col, item_id, item_text, window)
    signed = F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    hit = F.aggregate(signed, F.lit(0).cast("bigint"), lambda a, x: a + x)
    names = F.array_sort(F.array_distinct("items"))
    return found.select(
        id_col, "n_words", hit.alias("n_hit"), F.size(names).cast("bigint").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), "spans", (F.size("spans") > 0).alias("contaminated")
    )


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def without_spans(text: str | None, spans: list[tuple[int, int]], n_words: int, min_span: int, window: int, max_coverage: float, whole: set[tuple[int, int]]) -> str | None | bool:
    """The text without its long spans and whole short items, or False if it goes."""
    if sum(b - a for a, b in spans) > max_coverage * n_words:
        return False
    if not spans:
        return text
    at, cut, done = [m.span() for m in WORD.finditer(text)], [], 0
    for a, b in spans:
        if b - a >= min_span or any(a <= c and d <= b for c, d in whole):
            cut.append(text[done : at[a][0]])
            done = at[b - 1][1]
    return "".join([*cut, text[done:]])


def decontaminate(df: DataFrame, items: DataFrame, text_col: str = "text", window: int = 10, min_span: int = 10, max_coverage: float = 0.0) -> DataFrame:
    """``df`` without contamination: documents of whose words more than ``max_coverage`` lie in hit spans go; from the others
    hit spans of ``min_span`` words or more, and those that hold a whole item of fewer than ``window`` words, are cut out. All
    columns are kept; only the text changes. With ``max_coverage`` 0 every document with a hit goes.

    One group of automata: a map, without shuffle. More: the spans of texts with hits are joined to the documents.

    Null, empty or wordless texts stay as they are. Very long text: taken whole. Null ids and repeated rows: each row is judged
    by its text. Items without id or words: as in ``find_contamination``. Empty benchmark: nothing changes. Empty table: no rows.
    """
    schema, place = df.schema, df.columns.index(text_col)
    made = automata(items, "item_id", "text", window)
    one, second = next(made, None), next(made, None)
    if one is None:
        return df

    def judge(batch, spans_of):
        keep, texts = [], []
        for i, text in enumerate(batch.column(place).to_pylist()):
            spans, short, n = spans_of(i, text)
            left = without_spans(text, spans, n, min_span, window, max_coverage, short)
            keep.append(left is not False)
            texts.append(None if left is False else left)
        columns = [*batch.columns[: len(schema)]]
        columns[place] = pa.array(texts, batch.schema.types[place])
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names[: len(schema)]).filter(pa.array(keep, pa.bool_()))

    if second is None:

        def alone():
            a = one.value

            def spans_of(i, text):
                tokens, short = words(text), set()
                return a.matches(tokens, short)[0], short, len(tokens)

            return lambda whole: (judge(part, spans_of) for part in slices(whole, place))

        return batch_map(df, alone, schema)
    found = None
    for a in (one, second, *made):
        more = written(short_hits(df, a, text_col))
        found = more if found is None else found.union(more)
        a.unpersist()
    md5, spans, short = (unused(df, c) for c in ("md5", "spans", "short"))
    found = found.groupBy("text_md5").agg(F.flatten(F.collect_list("spans")).alias(spans), F.flatten(F.collect_list("short")).alias(short)).withColumnRenamed("text_md5", md5)
    with_md5 = df.withColumn(md5, F.unhex(F.md5(F.col(f"`{text_col}`").cast("binary"))))
    both = with_md5.join(found, md5, "left").select(*[f"`{c}`" for c in df.columns], merged(F.coalesce(spans, F.array().cast("array<int>"))).alias(spans), short)

    def joined():
        def work(whole):
            for part in slices(whole, place):
                s, k = part.column(len(schema)).to_pylist(), part.column(len(schema) + 1).to_pylist()
                pairs = lambda x: [*zip(x[::2], x[1::2], strict=True)]
                yield judge(part, lambda i, text: (pairs(s[i]), set(pairs(k[i] or [])), len(words(text))))

        return work

    return batch_map(both, joined, schema)


def short_hits(df: DataFrame, automaton: Broadcast, text_col: str) -> DataFrame:
    """(text_md5, spans, short) of the distinct texts with hits; ``short``: where whole short items stand."""

    def factory():
        a = automaton.value

        def work(texts):
            out = [[], [], []]
            for text in texts:
                short: set = set()
                spans = a.matches(words(text), short)[0]
                for column, x in zip(out, (hashlib.md5((text or "").encode()).digest(), [x for s in spans for x in s], [x for s in sorted(short) for x in s]), strict=True):
                    column.append(x)
            return out

        return work

    rows = map_texts(df.select(F.lit(0).alias("zero"), text_col), ["zero", text_col], {"zero": "int", "text_md5": "binary", "spans": "array<int>", "short": "array<int>"}, factory)
    return rows.where(F.size("spans") > 0).drop("zero").dropDuplicates(["text_md5"])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


#: The same by joining windows in SQL.
OP7_SQL = r"""
with d as (select doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select cast(item_id as varchar) as item, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
win as (select distinct item, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as s
        from (select item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from win),
occ as (select p.doc_id, p.i, p.n, win.item from (
          select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as s
          from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)) p
        join win on win.n = p.n and win.s = p.s),
hit as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + n)) as pos from (select distinct doc_id, i, n from occ)) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from occ) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join its using (doc_id)
"""
