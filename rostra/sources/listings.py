"""Listing pages: anchors, embedded state, nested folders, canonical links, headings."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostra.operators.joins import unused

ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
HEADING_REACH = 8000


def anchors(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, href, label): every anchor with its text, tags taken out."""
    found = F.posexplode(F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("h"), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("l"))).alias("pos", "x")
    label = F.trim(F.regexp_replace(F.regexp_replace("x.l", "<[^>]*>", ""), r"\s+", " "))
    return df.select(key, found).select(key, "pos", F.col("x.h").alias("href"), label.alias("label"))


def canonical_link(href: Column, base: str) -> Column:
    """Absolute, without fragment; paths are joined to the base."""
    bare = F.regexp_replace(F.trim(href), "#.*$", "")
    return F.when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), bare).when(F.startswith(bare, F.lit("/")), F.concat(F.lit(base.rstrip("/")), bare)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), bare))


#: Words of documents that are no protocols unless they are named so. Fixed values.
NO_PROTOCOLS = ("ärendelista", "arendelista", "föredragningslista", "kallelse", "reglemente", "arbetsordning", "budget", "rapport")


def is_protocol_pdf(title: Column, section: Column) -> Column:
    """A PDF whose title or section says protocol, or whose title begins with a date and neither names another kind."""
    name = F.lower(F.coalesce(title, F.lit("")))
    both = F.concat(name, F.lit(" "), F.lower(F.coalesce(section, F.lit(""))))
    named = F.contains(both, F.lit("protokoll"))
    other = F.exists(F.array(*[F.lit(w) for w in NO_PROTOCOLS]), lambda w: F.contains(both, w))
    return name.endswith(".pdf") & (named | (name.rlike(r"^20[0-9]{2}-[0-9]{2}-[0-9]{2}\s+") & ~other))


def preceding_heading(items: DataFrame, headings: DataFrame, key: str, at: str, label: str, reach: int = HEADING_REACH) -> DataFrame:
    """Each item with the last heading before it, no more than ``reach`` characters away. Both are merged and scanned once."""
    said, place, asks = (unused([key, at, label], c) for c in ("said", "place", "asks"))
    a = items.select(key, at, F.lit(None).cast("string").alias(said), F.lit(None).cast(items.schema[at].dataType).alias(place), F.lit(1).alias(asks))
    b = headings.select(key, at, F.col(label).alias(said), F.col(at).alias(place), F.lit(0).alias(asks))
    w = W.partitionBy(key).orderBy(at, F.desc(asks)).rowsBetween(W.unboundedPreceding, 0)
    both = a.union(b).select(key, at, asks, F.last(said, ignorenulls=True).over(w).alias(said), F.last(place, ignorenulls=True).over(w).alias(place))
    return both.where(F.col(asks) == 1).select(key, at, F.when(F.col(at) - F.col(place) <= reach, F.col(said)).alias(label))


def balanced_object(text: str, marker: str | int) -> str | None:
    """The braces that follow the marker, or a place, with quotes and escapes minded."""
    start = text.find(marker) if isinstance(marker, str) else marker
    start = text.find("{", start) if start >= 0 else -1
    depth, quote, i = 0, "", start
    while 0 <= i < len(text):
        c = text[i]
        if quote:
            i += c == "\\"
            if c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[start : i + 1]
        i += 1
    return None


def embedded_state(marker: str):
    """A column function: the JSON object that a page hands to ``marker``, or null."""
    @F.pandas_udf(T.StringType())
    def state(pages: pd.Series) -> pd.Series:
        def one(p):
            found = balanced_object(p, marker) if p else None
            try:
                return json.dumps(json.loads(found), ensure_ascii=False) if found else None
            except ValueError:
                return None

        return pages.map(one)

    return state


#: How a page hands a state to one of its components. Fixed pattern.
STATE_CALL = r"AppRegistry\.registerInitialState\(\s*['\"]([^'\"]+)['\"]\s*,"


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("component", T.StringType()), T.StructField("at", T.LongType()), T.StructField("state", T.StringType())])))
def registered_states(pages: pd.Series) -> pd.Series:
    """Every state that a page registers, with its component and where the call stands. What is no JSON object is left out; null
    pages have none."""
    call = re.compile(STATE_CALL)

    def one(page):
        found = []
        for m in call.finditer(page or ""):
            try:
                state = json.loads(balanced_object(page, m.end()) or "")
            except ValueError:
                continue
            found.append({"component": m[1], "at": m.start(), "state": json.dumps(state, ensure_ascii=False)})
        return found

    return pd.Series([one(p) for p in pages])


def page_states(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, component, at, state): a row for each state of each page."""
    return df.select(key, F.explode(registered_states(F.col(html))).alias("x")).select(key, "x.*")


def folder_files(df: DataFrame, key: str, state: str) -> DataFrame:
    """(key, label, name, url) of all files in nested folders; files carry the names of the folders above them."""
    def walk(node: dict, label: str) -> Iterator[tuple[str, str, str]]:
        for f in node.get("files") or []:
            yield label, f.get("name") or "", f.get("url") or ""
        for sub in node.get("folders") or []:
            yield from walk(sub, " / ".join(x for x in (label, sub.get("name") or "") if x))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, *row) for k, s in zip(pdf[key], pdf[state], strict=True) if s for row in walk(json.loads(s), "")], columns=[key, "label", "name", "url"])

    return df.select(key, state).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, label string, name string, url string")
