"""Text normalisation, fuzzy matching and relevance as column expressions.

Queries are known when the plan is made, so they are normalised and split on the driver and enter the plan as literals.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Latin letters whose decomposition is a base letter with marks, and their base letters."""
    pairs = [(chr(c), b[0]) for c in range(0xC0, 0x250) if len(b := unicodedata.normalize("NFD", chr(c).lower())) > 1 and b[0].isascii() and chr(c).lower() == chr(c)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folds()
#: Punctuation that parts words in headings of decisions. Fixed values.
PARTING = r"""[§.,:;!?()\[\]{}"'“”‘’\-–—/\\]+"""


def fold(col: Column) -> Column:
    """Lower case, without accents."""
    return F.regexp_replace(F.translate(F.lower(col), ACCENTED, PLAIN), "[̀-ͯ]", "")


def normalize_text(col: Column) -> Column:
    """Lower case, no accents, everything else than letters and digits to single blanks. ASCII texts have no accents to look for."""
    x = F.coalesce(col, F.lit(""))
    return F.trim(F.regexp_replace(F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(fold(x)), "[^a-z0-9]+", " "))


def normalize_decision(col: Column) -> Column:
    """Lower case, no accents; punctuation that parts words becomes single blanks, other signs stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(F.coalesce(col, F.lit(""))), PARTING, " "), r"\s+", " "))


def normalize_query(text: str) -> str:
    plain = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", text.lower()))
    return re.sub("[^a-z0-9]+", " ", plain).strip()


def tokens(normalized: Column, least: int = 1) -> Column:
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda x: F.length(x) >= least))


def distance_within(a: Column, b: Column, most: int) -> Column:
    return F.levenshtein(a, b, most).between(0, most)


def token_matches(q: str, t: Column) -> Column:
    """A query token against a text token: contained, same stem, or few edits apart with an end in common."""
    n, size = len(q), F.length(t)
    found = F.contains(t, F.lit(q))
    if n >= 6:
        long_stem = (F.lit(n >= 10)) & (size >= 10)
        stem = F.when(long_stem, F.substring(t, 1, 6) == q[:6]).otherwise(F.substring(t, 1, 5) == q[:5])
        found = found | ((size >= 6) & stem)
    if n >= 4:
        most = 2 if n >= 8 else 1
        ends = (F.substring(t, 1, 1) == q[0]) | (F.substring(t, -1, 1) == q[-1])
        found = found | ((size >= 4) & (F.abs(size - n) <= most) & ends & distance_within(F.lit(q), t, most))
    return found


def _on(f, q: str):
    """``f`` of a query token as a function of one column."""
    return lambda x: f(q, x)


def text_matches(text: Column, query: str) -> Column:
    """The phrase is contained, or each of up to six query tokens of three letters matches some text token."""
    q = normalize_query(query)
    if not q:
        return F.lit(True)
    t = normalize_text(text)
    found, parts = F.contains(t, F.lit(q)), [x for x in q.split(" ") if len(x) >= 3]
    if not parts or len(parts) > 6:
        return found
    each = tokens(t, 3)
    every = F.lit(True)
    for p in parts:
        every = every & F.exists(each, _on(token_matches, p))
    return found | every


def token_score(q: str, t: Column) -> Column:
    n, size, most = len(q), F.length(t), 2 if len(q) >= 8 else 1
    score = F.when(t == q, 180).when(t.startswith(q), 155)
    if n >= 5:
        score = score.when(F.startswith(F.lit(q), t) & (n - size <= 2), 125)
    if n >= 4:
        score = score.when((size >= 4) & (F.abs(size - n) <= most) & distance_within(F.lit(q), t, most), 105)
    return score.when(token_matches(q, t), 55).otherwise(0)


def field_score(text: Column, query: str) -> Column:
    """0 to 1000 and more: equal, phrase at the start, phrase later, or the sum of each query token's best match."""
    q = normalize_query(query)
    if not q:
        return F.lit(0)
    t, parts = normalize_text(text), q.split(" ")
    if len(parts) > 6:
        return F.when(t == q, 1000).when(F.contains(t, F.lit(q)), 700).otherwise(0)
    each, at = tokens(t), F.instr(t, q) - 1
    phrase = F.when(at == 0, 900).when(at > 0, F.greatest(F.lit(620), 780 - F.least(at, F.lit(160)))).otherwise(0)
    best = [F.coalesce(F.array_max(F.transform(each, _on(token_score, p))), F.lit(0)) for p in parts]
    every, total = F.lit(True), F.lit(220)
    for b in best:
        every, total = every & (b > 0), total + b
    return F.when(t == "", 0).when(t == q, 1000).when(every, F.greatest(phrase, total)).otherwise(phrase)


def likely_token(q: str, t: Column) -> Column:
    """Whether a text token can score at all for a query token, by cheap tests: every token that scores passes."""
    n, size, most = len(q), F.length(t), 2 if len(q) >= 8 else 1
    near = (size >= 4) & (F.abs(size - n) <= most) if n >= 4 else F.lit(False)
    stem = (size >= 6) & t.startswith(q[:5]) if n >= 6 else F.lit(False)
    return F.contains(t, F.lit(q)) | stem | near | (F.startswith(F.lit(q), t) & (n - size <= 2) if n >= 5 else F.lit(False))


def scored(df: DataFrame, key: str, text: str, query: str, keep: Sequence[str] = ()) -> DataFrame:
    """(key, keep, score) of the rows that score for a query of up to six tokens, equal to ``field_score``.

    Texts are cut into tokens once; only tokens that pass ``likely_token`` are compared by edits, and each row's best ones meet
    in a sum. Rows without text, and queries without tokens, score nothing.
    """
    parts = normalize_query(query).split()
    if not parts or len(parts) > 6:
        score = field_score(F.col(text), query) if parts else F.lit(0)
        return df.select(key, *keep, score.alias("score")).where("score > 0")
    q = " ".join(parts)
    rows = df.select(key, *keep, normalize_text(F.col(text)).alias("t")).select(key, *keep, (F.col("t") == q).alias("same"), (F.instr("t", q) - 1).alias("at"), F.split("t", " ").alias("w"))
    likely = lambda p: F.array_distinct(F.filter("w", lambda t: likely_token(p, t)))
    best = [F.coalesce(F.array_max(F.transform(likely(p), _on(token_score, p))), F.lit(0)) for p in parts]
    found = rows.select(key, *keep, "same", "at", F.array(*best).alias("b"))
    phrase = F.when(F.col("at") == 0, 900).when(F.col("at") > 0, F.greatest(F.lit(620), 780 - F.least(F.col("at"), F.lit(160)))).otherwise(0)
    total = F.when(F.forall("b", lambda x: x > 0), 220 + F.aggregate("b", F.lit(0), lambda a, x: a + x)).otherwise(0)
    return found.select(key, *keep, F.when(F.col("same"), 1000).otherwise(F.greatest(phrase, total)).alias("score")).where("score > 0")


def weighted_score(query: str, fields: Sequence[tuple[Column, float]]) -> Column:
    """The best field's weighted score, and a little for the support by the others."""
    scores = [field_score(c, query) * F.lit(float(w)) for c, w in fields]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    best = F.greatest(best, F.lit(0.0))
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    return best + F.least((total - best) * 0.08, F.lit(250.0))


def dropdown_score(label: Column, query: str) -> Column:
    """Ranks of options: equal, prefix, prefix of a word, contained, fuzzy; 0 for none."""
    q = normalize_query(query)
    if not q:
        return F.lit(1)
    t = normalize_text(label)
    words = F.filter(F.split(t, " "), lambda x: x != "")
    starts = F.transform(words, lambda x: x.startswith(q))
    at = F.array_position(starts, F.lit(True))
    word = F.try_element_at(words, F.greatest(at, F.lit(1)).cast("int"))
    pos, fuzzy = F.instr(t, q) - 1, field_score(label, query)
    return (
        F.when(t == "", 0)
        .when(t == q, 100000)
        .when(t.startswith(q), 90000 - F.least(F.lit(1000), F.length(t)))
        .when(at > 0, 80000 - (at - 1) * 100 - F.least(F.lit(99), F.length(word)))
        .when(pos >= 0, 70000 - F.least(F.lit(1000), pos * 10) - F.least(F.lit(99), F.length(t)))
        .when(fuzzy > 0, 10000 + fuzzy)
        .otherwise(0)
    )


def contains_all(text: Column, query: str) -> Column:
    """The phrase or each of its tokens of two letters is contained."""
    q, t = normalize_query(query), normalize_text(text)
    every = F.lit(True)
    for p in [x for x in q.split(" ") if len(x) > 1]:
        every = every & F.contains(t, F.lit(p))
    return F.contains(t, F.lit(q)) | every


def quick_match(fields: Sequence[Column], text: Column, query: str) -> Column:
    """Cheap containment in short fields first; the fuzzy match of the whole text only for the rest."""
    q, found = normalize_query(query), F.lit(False)
    for f in fields:
        found = found | F.contains(normalize_text(f), F.lit(q))
    return found | text_matches(text, query)
