"""Rule-based extraction from text: lines, sections, decision points, attendance, positions, tallies."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostra.functions.keys import ignorable_line, squeezed, stable_hash, text_or_empty

#: A diary number; registers count on, so its number has as many digits as it needs.
DIARY = "[A-ZÅÄÖ][A-Za-zÅÄÖåäö]{0,6} [0-9]+/20[0-9]{2}"


def lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line_no, line), counted from 0."""
    return df.select(*keys, F.posexplode(F.split(text_or_empty(F.col(text)), "\n")).alias("line_no", "line"))


def diary_from_first_page(text: Column) -> Column:
    """The diary number of a line on the protocol that has just one; else the only one in the first 20 lines; else empty."""
    first = F.slice(F.filter(F.transform(F.split(text, "\n"), squeezed), lambda x: x != ""), 1, 20)
    in_line = lambda x: F.regexp_extract_all(x, F.lit(f"({DIARY})"), F.lit(1))
    header = F.filter(F.transform(first, lambda x: F.when(F.contains(F.lower(x), F.lit("protokoll")) & (F.size(in_line(x)) == 1), F.element_at(in_line(x), 1))), lambda x: x.isNotNull())
    unique = F.array_distinct(F.flatten(F.transform(first, in_line)))
    return F.when(F.size(header) > 0, F.get(header, F.lit(0))).when(F.size(unique) == 1, F.get(unique, F.lit(0))).otherwise("")


def first_page_date(text: Column) -> Column:
    return F.regexp_extract(text_or_empty(text), r"(?im)^\s*Datum:\s*(20[0-9]{2}-[0-9]{2}-[0-9]{2})", 1)


def sections(pages: DataFrame, doc: str, page: str, text: str, start: str = r"^§ *([0-9]+)(.*)$") -> DataFrame:
    """(doc, section, title, first_page, last_page, n_lines, repeated): from a section's header to before the next.

    The last page is the last with a line that is no boilerplate.
    """
    rows = pages.select(doc, page, F.posexplode(F.split(text_or_empty(F.col(text)), "\n")).alias("n", "line"))
    header = F.col("line").rlike(start)
    order = W.partitionBy(doc).orderBy(page, "n").rowsBetween(W.unboundedPreceding, 0)
    numbered = rows.withColumn("s", F.sum(header.cast("int")).over(order)).where("s > 0")
    head = F.when(header, F.regexp_extract("line", start, 1))
    title = F.when(header, squeezed(F.regexp_extract("line", start, 2)))
    body = ~header & ~ignorable_line(F.col("line"))
    made = numbered.groupBy(doc, "s").agg(F.max(head).alias("section"), F.max(title).alias("title"), F.min(page).alias("first_page"), F.max(F.when(body, F.col(page))).alias("l"), F.count_if(~header).alias("n_lines"))
    again = F.count("*").over(W.partitionBy(doc, "section")) > 1
    return made.select(doc, "section", "title", "first_page", F.coalesce("l", "first_page").alias("last_page"), "n_lines", again.alias("repeated"))


def decision_points(df: DataFrame, key: str, section: str, text: str) -> DataFrame:
    """(key, point, decision): numbered items, each after the preamble; a text without items is one point."""
    rows = df.select(key, section, F.posexplode(F.split(text_or_empty(F.col(text)), "\n")).alias("n", "line"))
    item = F.regexp_extract("line", r"^\s*([0-9]+)\.\s*(.*)$", 1)
    bare = F.when(item != "", F.regexp_extract("line", r"^\s*([0-9]+)\.\s*(.*)$", 2)).otherwise(F.col("line"))
    w = W.partitionBy(key, section).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    numbered = rows.select("*", item.alias("i"), bare.alias("b")).withColumn("g", F.sum((F.col("i") != "").cast("int")).over(w))
    pieces = F.sort_array(F.collect_list(F.struct("n", "b")))
    joined = numbered.groupBy(key, section, "g").agg(F.max("i").alias("i"), squeezed(F.array_join(F.transform(pieces, lambda x: x["b"]), " ")).alias("t"))
    all_of = W.partitionBy(key, section)
    head, items = F.max(F.when(F.col("g") == 0, F.col("t"))).over(all_of), F.max("g").over(all_of)
    out = joined.select(key, section, "g", "i", "t", head.alias("h"), items.alias("k")).where("g > 0 or k = 0")
    return out.select(key, F.when(F.col("k") == 0, F.col(section)).otherwise(F.concat_ws(".", section, "i")).alias("point"), F.when(F.col("k") == 0, F.col("t")).otherwise(F.trim(F.concat_ws(" ", F.coalesce("h", F.lit("")), "t"))).alias("decision"))


PERSON = r"([A-ZÅÄÖ][\wÅÄÖåäöéü-]+(?: [A-ZÅÄÖ][\wÅÄÖåäöéü-]+)+) \(([A-Za-zÅÄÖåäö]{1,4})\)"
#: Stances by words of a request, in order of precedence. Fixed values.
STANCE_WORDS = (("bifall", "Bifallsyrkande"), ("avslag", "Avslagsyrkande"), ("återrem", "Återremissyrkande"), ("bordlägg", "Bordläggningsyrkande"))


def positions(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, name, party, stance, proposal): who moves what, by ``<people> yrkar <request>`` within a sentence, the people in the
    last 260 characters before. Of a person's motions of one stance, spelt in whatever case, the first counts; ``proposal``
    is named by a hash of keys, person and request."""
    move = r"(?iu)([^.!?]{0,260}?)\s+yrkar\s+([^.!?]+)"
    flat = squeezed(text_or_empty(F.col(text)))
    zipped = lambda x, pattern, a, b: F.arrays_zip(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)).alias(a), F.regexp_extract_all(x, F.lit(pattern), F.lit(2)).alias(b))
    moves = df.select(*keys, F.posexplode(zipped(flat, move, "who", "what")).alias("i", "x")).select(*keys, "i", "x.who", F.lower("x.what").alias("what"))
    stance = F.lit("Yrkande")
    for word, name in reversed(STANCE_WORDS):
        stance = F.when(F.contains("what", F.lit(word)), name).otherwise(stance)
    people = moves.select(*keys, "i", "what", stance.alias("stance"), F.posexplode(zipped(F.col("who"), PERSON, "n", "p")).alias("j", "x"))
    first = people.groupBy(*keys, F.lower("x.n").alias("a"), F.lower("x.p").alias("b"), "stance").agg(F.min(F.struct("i", "j", F.col("x.n").alias("name"), F.col("x.p").alias("party"), "what")).alias("m"))
    proposal = F.concat(F.lit("proposal_"), stable_hash(*[F.col(k).cast("string") for k in keys], F.col("m.name"), F.col("m.party"), F.col("m.what")))
    return first.select(*keys, "m.name", "m.party", "stance", proposal.alias("proposal"))


def attendance(pages: DataFrame, keys: list[str], page: str, text: str, headings: dict[str, str], most_pages: int = 3) -> DataFrame:
    """(keys, name, party, role) under role headings on the first pages; a heading of something else ends the list."""
    rows = pages.where(F.col(page) <= most_pages).select(*keys, page, F.posexplode(F.split(text_or_empty(F.col(text)), "\n")).alias("n", "line"))
    low = F.regexp_replace(F.lower(squeezed(F.col("line"))), ":$", "")
    role = F.when(F.startswith(low, F.lit("övriga")) | F.startswith(low, F.lit("paragraf")), F.lit(""))
    role = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in headings.items() for x in kv]), low), role)
    w = W.partitionBy(*keys).orderBy(page, "n").rowsBetween(W.unboundedPreceding, 0)
    held = rows.withColumn("role", F.last(role, ignorenulls=True).over(w)).where("role <> ''")
    at = "^\\s*" + PERSON
    return held.where(F.col("line").rlike(at)).select(*keys, F.regexp_extract("line", at, 1).alias("name"), F.regexp_extract("line", at, 2).alias("party"), "role").distinct()


def stated_tally(text: Column) -> Column:
    """Struct of counts stated for yes, no, abstain and absent; null where none is."""
    def count(word: str) -> Column:
        before = F.regexp_extract(text, rf"(?iu)(?:^|[^\p{{L}}]){word}(?:-röster|röster)?\s*[:=]?\s*([0-9]+)", 1)
        after = F.regexp_extract(text, rf"(?iu)(?:^|[^0-9])([0-9]+)\s+{word}(?:-röster|röster)?(?:$|[^\p{{L}}])", 1)
        return F.coalesce(F.nullif(before, F.lit("")), F.nullif(after, F.lit(""))).try_cast("int")

    return F.struct(*[count(w).alias(n) for w, n in (("ja", "yes"), ("nej", "no"), ("avstår", "abstain"), ("frånvarande", "absent"))])


def vote_held(text: Column) -> Column:
    low = F.lower(text_or_empty(text))
    return low.rlike("(^|[^a-zåäö])(omröstning|votering)([^a-zåäö]|$)") & low.rlike("begär|genomför|verkställ|utfall|röster|röstade")


@F.pandas_udf(T.StringType())
def repaired_meaning(truncated: pd.Series, source: pd.Series) -> pd.Series:
    """A text cut off in the middle, carried on to the end of its sentence where the source has it in full."""
    def one(t, s):
        if not t or not s or len(t) < 8:
            return t
        stem = r"\s+".join(re.escape(w) for w in t.rstrip(" -").split())
        found = re.search(stem + r"[^.!?\n]*[.!?]?", s)
        return re.sub(r"\s+", " ", found[0]).strip() if found else t

    return pd.Series([one(t, s) for t, s in zip(truncated, source, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])))
def text_blocks(texts: pd.Series) -> pd.Series:
    """Paragraphs and list items: blank lines part blocks, bullets and numbers begin items, other lines run on."""
    mark = re.compile(r"^\s*(?:[-•*–]|[0-9]{1,2}[.)])\s+")

    def one(text):
        out: list[dict] = []
        fresh = True
        for line in (text or "").split("\n"):
            if not line.strip():
                fresh = True
            elif mark.match(line):
                out.append({"kind": "item", "text": mark.sub("", line).strip()})
                fresh = False
            elif fresh:
                out.append({"kind": "paragraph", "text": line.strip()})
                fresh = False
            else:
                out[-1]["text"] += " " + line.strip()
        return out

    return pd.Series([one(t) for t in texts])
