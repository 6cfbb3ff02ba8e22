"""Token boundaries by associative scans of transition functions over codepoint classes; no regular expression.

The boundaries are those of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

# Symbols: letter, number, other, apostrophe before one or two letters of a contraction, white space before white space or
# the end, a blank before something else, other white space before something else, and the end of a text.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, BLANK, LONE, END = range(9)
# States: a token begins at the next character; inside letters, numbers, others; after a leading blank; inside white
# space; one or two letters of a contraction are due.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, IN_SPACE, DUE_1, DUE_2 = range(8)
#: Stands between texts; no text holds it.
STOP = 0x110000
BLOCK = 64


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token begins at the symbol."""
    if symbol == END:
        return FRESH, True
    if state in (DUE_1, DUE_2):
        return (FRESH if state == DUE_1 else DUE_1), False
    if symbol in (LETTER, NUMBER, OTHER):
        inside = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}[symbol]
        return inside, state not in (inside, AFTER_BLANK)
    if symbol in (SHORT, LONG):
        if state in (IN_OTHERS, AFTER_BLANK):
            return IN_OTHERS, False
        return (DUE_1 if symbol == SHORT else DUE_2), True
    if symbol == SPACE:
        return IN_SPACE, state != IN_SPACE
    return (AFTER_BLANK if symbol == BLANK else FRESH), True


@lru_cache(maxsize=1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All functions on states that strings of symbols can make: number of each symbol's, composition, result from FRESH, and
    whether a token begins at a symbol before which a function was applied to FRESH."""
    gen = [tuple(step(s, x)[0] for s in range(8)) for x in range(9)]
    known = {tuple(range(8)): 0}
    todo = [tuple(range(8))]
    while todo:
        f = todo.pop()
        for g in gen:
            if (h := tuple(g[s] for s in f)) not in known:
                known[h] = len(known)
                todo.append(h)
    functions = list(known)
    compose = np.array([[known[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)  # first f, then g
    starts = np.array([[step(f[FRESH], x)[1] for x in range(9)] for f in functions])
    return np.array([known[g] for g in gen], np.uint16), compose, np.array([f[FRESH] for f in functions], np.uint8), starts


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE of every codepoint; END for STOP."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    spaces = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[spaces] = SPACE
    return np.append(out, np.uint8(END))


def scan(functions: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Exclusive prefix compositions: rows of BLOCK are composed side by side, then their totals by the same scan."""
    n = len(functions)
    if n <= BLOCK:
        out, f = np.zeros(n, np.uint16), np.uint16(0)
        for i in range(n):
            out[i] = f
            f = compose[f, functions[i]]
        return out
    rows = -(-n // BLOCK)
    padded = np.zeros(rows * BLOCK, np.uint16)
    padded[:n] = functions
    columns = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)  # column j of each row stands together
    size, flat = len(compose), compose.ravel()
    before = np.empty_like(columns)
    f = np.zeros(rows, np.uint16)
    for j in range(BLOCK):
        before[j] = f
        f = flat.take(f.astype(np.int32) * size + columns[j])
    carried = scan(f, compose)
    return flat.take(carried.astype(np.int32) * size + before).T.reshape(-1)[:n]


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where tokens begin, for codepoints of texts that are each followed by STOP; STOP begins a token of its own."""
    symbol_function, compose, _, starts = monoid()
    kind = classes()[points]
    after = np.append(kind[1:], np.uint8(END))
    last_space = np.flatnonzero((kind == SPACE) & (after != SPACE) & (after != END))
    symbols = kind
    symbols[last_space] = np.where(points[last_space] == 0x20, BLANK, LONE)
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        ahead = np.append(points, [STOP, STOP])
        a, b = ahead[quotes + 1], ahead[quotes + 2]
        symbols[quotes[np.isin(a, [*b"stmd"])]] = SHORT
        pair = np.isin(a, [*b"rv"]) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        symbols[quotes[pair]] = LONG
    before = scan(symbol_function[symbols], compose)
    return np.flatnonzero(starts.ravel().take(before.astype(np.int32) * 9 + symbols))
