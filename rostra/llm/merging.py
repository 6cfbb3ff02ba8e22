"""Byte-pair merging of many words at a time in numpy."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable

import numpy as np

NONE = np.int32(2**31 - 1)
#: Words of at most so many bytes are merged as rows of a matrix, longer ones singly with a heap.
ROW = 40


class PairMerger:
    """Merges adjacent symbols, lowest rank first and leftmost among equals, until no pair has a rank.

    ``pairs``: (left id, right id, rank, new id); ranks below 2**31, ids below 2**24.
    ``first``: ids of the 256 bytes; ``last``: the same for a word's last byte, where the vocabulary marks word ends.
    """

    def __init__(self, pairs: Iterable[tuple[int, int, int, int]], first: np.ndarray, last: np.ndarray | None = None):
        left, right, rank, new = np.array(list(pairs), dtype=np.int64).reshape(-1, 4).T
        self.first, self.last = first.astype(np.int32), (first if last is None else last).astype(np.int32)
        keys = (left << 24) | right
        self.bits = max(4, int(len(keys) * 3).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks, self.news = np.full(size, -1, np.int64), np.full(size, NONE, np.int32), np.zeros(size, np.int32)
        slot, todo = self.home(keys), np.arange(len(keys))
        while len(todo):  # open addressing: in each round one key takes each free slot, the others move on
            free = self.keys[slot[todo]] == -1
            at, won = np.unique(slot[todo][free], return_index=True)
            took = todo[free][won]
            self.keys[at], self.ranks[at], self.news[at] = keys[took], rank[took], new[took]
            todo = np.setdiff1d(todo, took, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; a slot of a pair without rank has rank NONE."""
        keys = (left.astype(np.int64) << 24) | right
        slot = self.home(keys)
        got = self.keys[slot]
        off = np.flatnonzero((got != keys) & (got != -1))
        while len(off):
            slot[off] = (slot[off] + 1) & (len(self.keys) - 1)
            got = self.keys[slot[off]]
            off = off[(got != keys[off]) & (got != -1)]
        return slot

    def rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges the rows of a matrix of ids; gives the ids, packed to the left, and each row's number of ids."""
        m, width = ids.shape
        out, count = ids.copy(), np.full(m, width, np.int32)
        if width < 2 or not m:
            return out, count
        alive, cols = np.arange(m), np.arange(width)
        slots = self.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(m, width - 1)
        # column j: rank of the pair (j, j + 1); the last two columns stay NONE
        ranks = np.concatenate([self.ranks[slots], np.full((m, 1), NONE, np.int32)], axis=1)
        ids, n = ids.copy(), count.copy()
        while len(alive):
            at = ranks.argmin(axis=1)
            row = np.arange(len(alive))
            live = ranks[row, at] != NONE
            if not live.all():
                done = ~live
                out[alive[done]], count[alive[done]] = ids[done], n[done]
                alive, ids, ranks, n, at = alive[live], ids[live], ranks[live], n[live], at[live]
                row = np.arange(len(alive))
                if not len(alive):
                    break
            made = self.news[self.find(ids[row, at], ids[row, at + 1])]
            take = np.minimum(cols + (cols > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, take, axis=1)
            ranks = np.take_along_axis(ranks, take, axis=1)
            ids[row, at] = made
            n -= 1
            ranks[row, n - 1] = NONE  # pairs begin at 0 to n - 2
            for where in (at - 1, at):
                ok = np.flatnonzero((where >= 0) & (where < n - 1))
                w = where[ok]
                ranks[ok, w] = self.ranks[self.find(ids[ok, w], ids[ok, w + 1])]
        return out, count

    def long(self, symbols: np.ndarray) -> np.ndarray:
        """One long word: a heap of ranked pairs over a linked list, n log n."""
        ids, n = symbols.tolist(), len(symbols)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        ranks = self.ranks[self.find(symbols[:-1], symbols[1:])]
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i] = int(self.news[self.find(np.array([a]), np.array([b]))[0]])
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n:
                    r = int(self.ranks[self.find(np.array([ids[x]]), np.array([ids[y]]))[0]])
                    if r != NONE:
                        heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        by_size, out = defaultdict(list), [b""] * len(words)
        for i, w in enumerate(words):
            by_size[len(w)].append(i)
        for size, rows in by_size.items():
            if not size:
                continue
            raw = np.frombuffer(b"".join([words[i] for i in rows]), np.uint8).reshape(len(rows), size)
            ids = self.first[raw]
            ids[:, -1] = self.last[raw[:, -1]]
            if size > ROW:
                for i, x in zip(rows, ids, strict=True):
                    out[i] = self.long(x).astype("<u4").tobytes()
                continue
            for start in range(0, len(rows), 4096):
                got, count = self.rows(ids[start : start + 4096])
                flat, step = got.astype("<u4").tobytes(), 4 * size
                for k, (i, n) in enumerate(zip(rows[start : start + 4096], count.tolist(), strict=True)):
                    out[i] = flat[k * step : k * step + 4 * n]
        return out


class Cache:
    """A mapping in two generations: what was used since the last change of generation survives the next.

    ``most``: bytes that a generation holds, about (a key's characters, and 160 for each entry); one call's own keys are
    always held, even where they are more. ``fixed``: what is held for good, and not counted.
    """

    def __init__(self, most: int, fixed: dict | None = None):
        self.most, self.fixed, self.young, self.old, self.size = most, fixed or {}, dict(fixed or {}), {}, 0

    @staticmethod
    def weight(keys) -> int:
        return 160 * len(keys) + 2 * sum(map(len, keys))

    def holding(self, keys: set, make) -> dict:
        """A dictionary that holds all keys; ``make`` gives the values of a list of those that are missing."""
        young = self.young
        if missing := keys.difference(young):
            more = self.weight(missing)
            if self.size + more > self.most:
                self.old, self.young, self.size = young, (young := dict(self.fixed)), 0
                missing = keys.difference(young)
                more = self.weight(missing)
            self.size += more
            if self.old:
                old = self.old
                for k in missing & old.keys():
                    young[k] = old[k]
                missing = missing.difference(young)
            if missing:
                todo = list(missing)
                young.update(zip(todo, make(todo), strict=True))
            if self.size > self.most:  # one call's keys alone: the next call begins anew
                self.young, self.old, self.size = dict(self.fixed), {}, 0
        return young
