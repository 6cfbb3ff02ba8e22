"""The word-level BPE vocabulary (lower case, word ends), with the whole-token shortcut.

Used by token counts (operator 1) and by the ORC writer (operator 10).
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex

from pyspark.sql import SparkSession

from rostra.llm.common import broadcast_file
from rostra.llm.merging import Cache, PairMerger

#: Bytes of distinct pre-tokens cached per worker in each of two generations, about; fewer cost time only.
CACHE = 96 << 20


def byte_chars() -> str:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(rest)) for b in range(256))


def load(raw: bytes):
    """The library's tokenizer from the bytes of its file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_buffer(raw)


@lru_cache(maxsize=2)
def whole_tokens(raw: bytes) -> dict[str, int]:
    """Texts proven to be one token: every vocabulary string with a word end is put through all merges, and kept if one token results.

    Runs once, with the library's own model, before any document is read.
    """
    spec = json.loads(raw)
    suffix, model = spec["model"]["end_of_word_suffix"], load(raw).model
    back, found = {c: b for b, c in enumerate(byte_chars())}, {}
    for piece, i in spec["model"]["vocab"].items():
        if not piece.endswith(suffix) or not (bare := piece[: -len(suffix)]):
            continue
        out = model.tokenize(bare)
        if len(out) == 1 and out[0].id == i:
            try:
                found[bytes(back[c] for c in bare).decode()] = i
            except (KeyError, UnicodeDecodeError):
                continue  # no whole characters, so no pre-token looks like it
    return found


@dataclass(frozen=True)
class CharTables:
    """What the library makes of each codepoint, whatever version of Unicode it follows.

    ``lower``: (codepoint, lower case) where they differ; ``letters``, ``numbers``, ``spaces``: ranges for a character class;
    ``odd``: a class of codepoints that the library composes or orders in another way than this Python does; ``agreed``: below
    this codepoint Python and its modules take letters, numbers and cases as the library does.
    """

    lower: tuple[tuple[int, str], ...]
    letters: str
    numbers: str
    spaces: str
    odd: str
    agreed: str


def ranges(points: list[int]) -> str:
    """A character class's inside for ascending codepoints."""
    x = np.array(points)
    if not len(x):
        return ""
    cut = np.flatnonzero(np.diff(x) != 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(x[np.append(0, cut + 1)].tolist(), x[np.append(cut, len(x) - 1)].tolist(), strict=True))


@lru_cache(maxsize=1)
def char_tables() -> CharTables:
    """Asked of the library once, over all codepoints, before any document is read."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]

    def matching(pattern: str) -> list[str]:
        one = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        return [c for k in range(0, len(chars), 50_000) for c, _ in one.pre_tokenize_str("".join(chars[k : k + 50_000]))]

    low, nfc, nfd = normalizers.Lowercase().normalize_str, normalizers.NFC().normalize_str, normalizers.NFD().normalize_str
    odd = set()
    for c in chars:
        if c < "\u0300":
            continue
        own, py = nfd(c), unicodedata.normalize("NFD", c)
        if own != py:
            odd.update(c + own + py)
        # marks of the lowest and the highest class show whether both know the same class of c
        elif unicodedata.combining(c) or not unicodedata.category(c)[0] in "LNPSZ":
            if any(nfc(x) != unicodedata.normalize("NFC", x) for x in ("\u0345" + c, c + "\u0334")):
                odd.add(c)
        if len(py) > 1 and nfc(py) != unicodedata.normalize("NFC", py):
            odd.update(py)
    lower, letters, numbers, spaces = {c: x for c in chars if (x := low(c)) != c}, matching(r"\p{L}"), matching(r"\p{N}"), matching(r"\s")
    text = "".join(chars)
    differ = odd | set(letters) ^ {c for c in chars if c.isalpha()} | set(letters) ^ set(regex.findall(r"\p{L}", text)) | set(numbers) ^ set(regex.findall(r"\p{N}", text))
    differ |= {c for c in chars if c.lower() != lower.get(c, c)}
    points = lambda x: ranges(sorted(map(ord, x)))
    return CharTables(tuple((ord(c), x) for c, x in lower.items()), points(letters), points(numbers), points(spaces), points(odd), min(differ, default=chr(sys.maxunicode)))


def merger(spec: dict) -> PairMerger:
    """The vocabulary's merges over the ids of its single characters."""
    vocab, suffix, chars = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"], byte_chars()
    pairs = []
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        pairs.append((vocab[a], vocab[b], rank, vocab[a + b]))
    return PairMerger(pairs, np.array([vocab[c] for c in chars]), np.array([vocab[c + suffix] for c in chars]))


class WordEncoder:
    """Ids of whole texts, equal to the library's with special strings handled as its default and none added.

    Texts are normalised and split by the vocabulary's pattern; pre-tokens proven whole are looked up, and only the others are
    merged, each distinct one once while it is cached.
    """

    def __init__(self, raw: bytes, whole: dict[str, int], chars: CharTables):
        spec = json.loads(raw)
        self.merger = merger(spec)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split").replace("\\s", chars.spaces)
        self.split = regex.compile(pattern)
        # most texts have Latin letters only, for which classes without properties are faster
        kind = {n: "".join(re.escape(c) for c in map(chr, range(256)) if regex.match(f"[{x}]", c)) for n, x in (("L", chars.letters), ("N", chars.numbers), ("S", chars.spaces))}
        contractions = "".join(f"{re.escape(x)}|" for x in pattern.split("|") if x.isascii() and x.startswith("'"))
        self.split_latin = re.compile(f"[{kind['L']}]+|[{kind['N']}]|{contractions}[^{kind['S']}{kind['L']}{kind['N']}]+")
        self.beyond_latin = re.compile("[^\x00-\xff]")
        self.split_any = regex.compile(pattern.replace("\\p{L}", chars.letters).replace("\\p{N}", chars.numbers))
        self.high = re.compile(f"[{re.escape(chars.agreed)}-\U0010ffff]")
        self.lower, self.odd = dict(chars.lower), regex.compile(f"[{chars.odd}]") if chars.odd else None
        self.special = {t["content"]: struct.pack("<I", t["id"]) for t in spec["added_tokens"]}
        self.find_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.packed, self.counted = Cache(CACHE, {w: struct.pack("<I", i) for w, i in whole.items()}), Cache(CACHE, dict.fromkeys(whole, 1))

    def composed(self, text: str) -> str:
        if self.odd and self.odd.search(text):
            from tokenizers import normalizers

            return normalizers.NFC().normalize_str(text)
        return unicodedata.normalize("NFC", text)

    def pre_tokens(self, text: str) -> list[str]:
        """In lower case character by character, so a final sigma is none."""
        if not self.beyond_latin.search(text):
            return self.split_latin.findall(text.lower())  # composed already, and stays within Latin-1
        if self.high.search(text):
            return self.split_any.findall(self.composed(text).translate(self.lower))
        return self.split.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def runs(self, text: str | None):
        """Lists of pre-tokens, and between them the packed ids of special strings."""
        for k, part in enumerate(self.find_special.split(text) if text and "<|" in text else [text or ""]):
            yield self.special[part] if k % 2 else self.pre_tokens(part)

    def folded(self, cache: Cache, make, texts, one, join) -> list:
        """Per text, what its pre-tokens join to; those of all texts are looked up together."""
        runs = [[*self.runs(t)] for t in texts]
        at = cache.holding(set().union(*[r for rs in runs for r in rs if isinstance(r, list)]), make).__getitem__
        return [join(one(r) if isinstance(r, bytes) else join(map(at, r)) for r in rs) for rs in runs]

    def merged(self, words: list[str]) -> list[bytes]:
        return self.merger.merge([w.encode() for w in words])

    def counts(self, texts: list[str | None]) -> list[int]:
        return self.folded(self.counted, lambda new: [len(x) // 4 for x in self.merged(new)], texts, lambda special: 1, sum)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.folded(self.packed, self.merged, texts, bytes, b"".join)


@lru_cache(maxsize=2)
def encoder(raw: bytes, whole: tuple[tuple[str, int], ...], chars: CharTables) -> WordEncoder:
    """One per Python worker, so that what a task has cached serves the next."""
    return WordEncoder(raw, dict(whole), chars)


def shared_encoder(spark: SparkSession, vocabulary: str):
    """A function that gives workers their encoder: the file, the proven tokens and the character tables are broadcast, all of a vocabulary's size."""
    raw = broadcast_file(spark, vocabulary)
    held = spark.sparkContext.broadcast((tuple(whole_tokens(raw.value).items()), char_tables()))
    return lambda: encoder(raw.value, *held.value)
