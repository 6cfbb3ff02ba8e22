"""Data-quality rules as queries whose rows are issues, and the gate over them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostra.functions.keys import text_or_empty
from rostra.operators.joins import spread, unused


@dataclass(frozen=True)
class Rule:
    """``find`` gives the offending rows' keys as one text column ``key``."""

    name: str
    severity: str  # error or review
    find: Callable[[], DataFrame]


def issues(rules: Sequence[Rule]) -> DataFrame:
    """(category, severity, key) of all rules; they run as one job."""
    frames = [r.find().select(F.lit(r.name).alias("category"), F.lit(r.severity).alias("severity"), F.col("key").cast("string").alias("key")) for r in rules]
    return reduce(DataFrame.unionByName, frames)


def counted(found: DataFrame, samples: int = 8) -> DataFrame:
    """(category, severity, n, samples): counts, and the first keys of each category.

    Samples are taken per category from a ranked window of distinct keys, so no list grows with the issues.
    """
    counts = found.groupBy("category", "severity").agg(F.count("*").alias("n"))
    keys = found.groupBy("category", "key").agg(F.lit(1).alias("_")).withColumn("r", F.row_number().over(W.partitionBy("category").orderBy("key"))).where(F.col("r") <= samples)
    first = keys.groupBy("category").agg(F.array_join(F.sort_array(F.collect_list("key")), ",").alias("samples"))
    return counts.join(first, "category")


def gate(found: DataFrame, blocking: Sequence[str] = ("error", "review")) -> DataFrame:
    """One row: the number of blocking issues, and whether publishing may go on."""
    return found.agg(F.count_if(F.col("severity").isin(*blocking)).alias("blocking")).withColumn("passes", F.col("blocking") == 0)


def missing(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys of rows in which a required column is empty."""
    return df.where(reduce(lambda a, b: a | b, [text_or_empty(F.col(c)) == "" for c in columns])).select(F.col(key).alias("key"))


def repeated(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    # keys hardly repeat, so there is nothing to sum up before they are dealt
    return spread(df.select(*columns), *columns).groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1").select(F.concat_ws("|", *columns).alias("key"))


def dangling(df: DataFrame, parents: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Keys of rows whose parent does not exist."""
    asks = spread(df.select(*dict.fromkeys([*columns, key])), *columns)
    return asks.join(spread(parents.select(*columns), *columns), list(columns), "left_anti").select(F.col(key).alias("key"))


def archive_rules(files: DataFrame, key: str, path: str, meeting: Sequence[str]) -> list[Rule]:
    """Rules of an archive: every file has a relative path within it, and no two files are of one meeting."""
    held = text_or_empty(F.col(path))
    outside = held.startswith("/") | held.contains("\\") | F.array_contains(F.split(held, "/"), "..")
    return [
        Rule("path_missing", "error", lambda: missing(files, key, [path])),
        Rule("path_outside", "error", lambda: files.where(outside).select(F.col(key).alias("key"))),
        Rule("repeated_meeting", "error", lambda: repeated(files, meeting)),
    ]


def document_rules(docs: DataFrame, hosts: Sequence[str], boilerplate: str) -> list[Rule]:
    """Rules of documents (id, date, title, url, text): ids count once, dates are dates, a date in the title is the document's, the
    url's host is known, and no boilerplate is left in the text."""
    key, date = F.col("id").alias("key"), text_or_empty(F.col("date"))
    in_title = F.regexp_extract(text_or_empty(F.col("title")), r"(20[0-9]{2}-[0-9]{2}-[0-9]{2})", 1)
    host = F.lower(F.regexp_extract(text_or_empty(F.col("url")), "^[a-zA-Z]+://([^/?#]*)", 1))
    return [
        Rule("repeated_id", "error", lambda: repeated(docs, ["id"])),
        Rule("bad_date", "error", lambda: docs.where(F.try_to_date(date, "yyyy-MM-dd").isNull() | ~date.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")).select(key)),
        Rule("title_date_differs", "review", lambda: docs.where((in_title != "") & (in_title != date)).select(key)),
        Rule("unknown_host", "error", lambda: docs.where(~host.isin(*hosts)).select(key)),
        Rule("boilerplate_left", "review", lambda: docs.where(text_or_empty(F.col("text")).rlike(boilerplate)).select(key)),
    ]


def ballot_rules(ballots: DataFrame, points: DataFrame, stated: DataFrame, votes: Sequence[str]) -> list[Rule]:
    """Rules of ballots (id, name, vote, event): their point exists, votes are known, events are named, and no event has more named
    votes than are stated (event, n). Where ``stated`` has a column ``vote``, votes of that kind alone are counted against it."""
    key, kind = F.col("id").alias("key"), ["event", "vote"] if "vote" in stated.columns else ["event"]
    named = ballots.where(text_or_empty(F.col("event")) != "").groupBy(*kind).agg(F.count("*").alias("named"))
    return [
        Rule("ballot_without_point", "error", lambda: dangling(ballots, points, ["id"], "id")),
        Rule("unknown_vote", "error", lambda: ballots.where(~text_or_empty(F.col("vote")).isin(*votes)).select(key)),
        Rule("event_missing", "error", lambda: ballots.where(text_or_empty(F.col("event")) == "").select(key)),
        Rule("named_over_stated", "review", lambda: named.join(stated, kind).where("named > n").select(F.concat_ws("|", *kind).alias("key"))),
    ]


def attendance_rules(attendance: DataFrame, meetings: DataFrame, voters: DataFrame) -> list[Rule]:
    """Rules of attendance (meeting, name): its meeting exists, and whoever voted (meeting, name) was there."""
    return [
        Rule("unknown_meeting", "error", lambda: dangling(attendance, meetings, ["meeting"], "meeting")),
        Rule("voter_missing", "review", lambda: voters.distinct().join(attendance.select("meeting", "name").distinct(), ["meeting", "name"], "left_anti").select(F.concat_ws("|", "meeting", "name").alias("key"))),
    ]


def parity(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, field) in which derived and source rows differ; nulls equal nulls."""
    a, b = (unused([key], side) for side in ("left_row", "right_row"))
    both = left.select(key, F.struct(*columns).alias(a)).join(right.select(key, F.struct(*columns).alias(b)), key, "full")
    differing = F.array_compact(F.array(*[F.when(~F.col(f"{a}.`{c}`").eqNullSafe(F.col(f"{b}.`{c}`")), F.lit(c)) for c in columns]))
    return both.select(key, F.explode(differing).alias("field"))


def best_copy(df: DataFrame, same: str, order: Sequence) -> DataFrame:
    """Of rows with the same content the first in order is kept: (all columns, copies). Orders are expressions that compare
    upwards; one row of each content is kept before anything is shuffled."""
    every = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(same).agg(F.min_by(every, F.struct(*order, every)).alias("first"), F.count("*").alias("copies")).select("first.*", "copies")
