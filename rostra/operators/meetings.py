"""Meetings: rollups, representatives, summaries, stances and attendance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Order of stances in lists. Fixed values.
STANCES = ("Bifallsyrkande", "Avslagsyrkande", "Återremissyrkande", "Bordläggningsyrkande", "Yrkande")


def decision_summary(points: DataFrame, meeting: str = "meeting", matter: str = "matter", point: str = "point", vote_ids: str = "vote_ids", events: DataFrame | None = None) -> DataFrame:
    """One row: rows, distinct matters, meetings, points and vote events.

    Vote ids are unnested on a branch of their own, or come as rows ``events`` with a column ``event``, so that the other
    distinct counts are not multiplied.
    """
    counts = points.agg(F.count("*").alias("n_rows"), F.count_distinct(matter).alias("matters"), F.count_distinct(meeting).alias("meetings"), F.count_distinct(meeting, matter, point).alias("decisions"))
    each = points.select(F.explode(vote_ids).alias("e")) if events is None else events.select(F.col("event").alias("e"))
    return counts.join(F.broadcast(each.agg(F.count_distinct("e").alias("vote_events"))))  # one row


def meeting_rollup(points: DataFrame, keys: Sequence[str], decision: str, matter: str, attendance: DataFrame | None = None, person: str = "name", first_by: Sequence[str] = ()) -> DataFrame:
    """Per meeting: decisions and matters, and people present; with ``first_by`` the decision that stands for it, the first in that order."""
    stands = [F.min_by(decision, F.struct(*first_by)).alias("first")] if first_by else []
    roll = points.groupBy(*keys).agg(F.count_distinct(decision).alias("n_decisions"), F.count_distinct(matter).alias("n_matters"), *stands)
    if attendance is None:
        return roll
    present = attendance.groupBy(*keys).agg(F.count_distinct(person).alias("n_present"))
    return roll.join(present, list(keys), "left").fillna(0, ["n_present"])


def representative(rows: DataFrame, keys: Sequence[str], attendees: str, title: str) -> DataFrame:
    """The row that stands for a meeting: most attendees, title without a section mark, smallest title."""
    every = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    order = F.struct(F.negative(attendees), F.startswith(F.col(title), F.lit("§")).cast("int"), F.col(title), every)
    return rows.groupBy(*keys).agg(F.min_by(every, order).alias("r")).select("r.*")


def rolled_text(rows: DataFrame, keys: Sequence[str], order: str, text: str) -> DataFrame:
    """Children's texts in order as one."""
    pieces = F.sort_array(F.collect_list(F.struct(order, text)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda x: x[text]), " ").alias("rolled"))


def stance_groups(positions: DataFrame, keys: Sequence[str], stance: str = "stance") -> DataFrame:
    """Distinct (name, party) of each kind of stance, in the fixed order."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STANCES]), F.col(stance))
    return positions.groupBy(*keys, stance).agg(F.count_distinct("name", "party").alias("n")).withColumn("stance_rank", F.when(rank > 0, rank).otherwise(len(STANCES) + 1).cast("int"))


def attendance_by_role(attendance: DataFrame, keys: Sequence[str], role_group: Column) -> DataFrame:
    """Distinct (name, party, role) counted in each group of roles."""
    seen = attendance.select(*keys, "name", "party", "role", role_group.alias("role_group")).distinct()
    return seen.groupBy(*keys, "role_group").agg(F.count("*").alias("n"))


def document_summary(docs: DataFrame, kind: str, dated: Column, summarized: Column) -> DataFrame:
    return docs.agg(F.count("*").alias("n_documents"), F.count_distinct(kind).alias("n_types"), F.count_if(dated).alias("n_dated"), F.count_if(summarized).alias("n_summarized"))
