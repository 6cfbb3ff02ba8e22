"""Vote tallies: pivots of named ballots, stated counts, and how they are reconciled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vote values in their fixed order, and the counters made of them.
VOTES = {"Ja": "yes", "Nej": "no", "Avstår": "abstain", "Frånvarande": "absent"}
COUNTERS = tuple(VOTES.values())


def event_base(event: Column) -> Column:
    """A participant's id without its last ``:`` segment."""
    return F.regexp_replace(event, ":[^:]*$", "")


def split_ids(csv: Column) -> Column:
    return F.filter(F.transform(F.split(csv, ","), lambda x: F.trim(x)), lambda x: x != "")


def tally(ballots: DataFrame, keys: Sequence[str], vote: str = "vote", event: str = "event") -> DataFrame:
    """Per key: named ballots, one counter for each vote value, distinct vote events."""
    counters = [F.count_if(F.col(vote) == value).alias(name) for value, name in VOTES.items()]
    return ballots.groupBy(*keys).agg(F.count("*").alias("named"), *counters, F.count_distinct(event).alias("rounds"))


def with_tally(points: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every point with its totals; zeros where nobody voted."""
    return points.join(totals, list(keys), "left").fillna(0, ["named", *COUNTERS, "rounds"])


def stated_first(named: Column, stated: Column) -> Column:
    """The stated count where there is one above zero, else the named one."""
    return F.coalesce(F.when(stated != 0, stated), named, F.lit(0))


def merge_stated(df: DataFrame) -> DataFrame:
    """Counters merged with ``stated_*``; ``voters`` is the larger of named ballots and the four counts."""
    merged = df.withColumns({c: stated_first(F.col(c), F.col(f"stated_{c}")) for c in COUNTERS})
    return merged.withColumn("voters", F.greatest("named", sum((F.col(c) for c in COUNTERS), F.lit(0))))


def canonical_totals(points: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counters stated for the point; where one is not above zero, the sum over the point's events.

    A point for which all four come out zero keeps its own counters.
    """
    sums = events.groupBy(*keys).agg(*[F.sum(f"stated_{c}").alias(f"event_{c}") for c in COUNTERS])
    both = points.join(sums, list(keys), "left")
    found = {c: F.coalesce(F.when(F.col(f"stated_{c}") > 0, F.col(f"stated_{c}")), F.col(f"event_{c}"), F.lit(0)) for c in COUNTERS}
    any_found = sum(found.values(), F.lit(0)) > 0
    return both.select(*keys, *[F.when(any_found, x).otherwise(F.coalesce(c, F.lit(0))).alias(c) for c, x in found.items()])


def mark_conflicts(events: DataFrame, ballots: DataFrame, key: str = "event", vote: str = "vote") -> DataFrame:
    """Events whose named list exceeds a stated count are in conflict; if the totals agree, named counts replace the stated."""
    named = ballots.groupBy(key).agg(*[F.count_if(F.col(vote) == v).alias(f"named_{c}") for v, c in VOTES.items()])
    both = events.join(named, key, "left").fillna(0, [f"named_{c}" for c in COUNTERS])
    over = F.lit(False)
    for c in COUNTERS:
        over = over | F.coalesce(F.col(f"named_{c}") > F.col(f"stated_{c}"), F.lit(False))
    total = lambda kind: sum((F.coalesce(f"{kind}_{c}", F.lit(0)) for c in COUNTERS), F.lit(0))
    fixed = over & (total("named") == total("stated"))
    counters = [F.when(fixed, F.col(f"named_{c}")).otherwise(F.col(f"stated_{c}")).alias(f"stated_{c}") for c in COUNTERS]
    return both.select(key, *counters, over.alias("count_conflict"), fixed.alias("reconciled"))


def ballots_by_group(ballots: DataFrame, event: str = "event", vote: str = "vote", party: str = "party", name: str = "name") -> DataFrame:
    """Ballots of each event by vote and party, with the names in order."""
    return ballots.groupBy(event, vote, party).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(F.col(name).cast("string"))), "|").alias("names"))


def filtered_points(points: DataFrame, ballots: DataFrame, positions: DataFrame, attendance: DataFrame, parties: Sequence = (), members: Sequence = (), votes: Sequence = ()) -> DataFrame:
    """Points with a participant that the request asks for.

    A point stays if a ballot or a position on it fits party, member and vote; or, where members but no votes are asked
    for, if a fitting participant attended its meeting. Keys are made distinct before each semi join, so the probe side is
    never multiplied.
    """
    if not (parties or members or votes):
        return points

    def fits(df: DataFrame, with_vote: bool) -> DataFrame:
        for col, chosen in (("party", parties), ("name", members), ("vote", votes if with_vote else ())):
            if chosen:
                df = df.where(F.col(col).isin(list(chosen)))
        return df

    by_ballot = fits(ballots, True).select("id")
    by_position = fits(positions, False).select("id") if not votes else positions.select("id").limit(0)
    hit = points.join(by_ballot.union(by_position).distinct(), "id", "left_semi")
    if not members or votes:
        return hit
    present = points.join(fits(attendance, False).select("meeting").distinct(), "meeting", "left_semi")
    return hit.unionByName(present.join(hit.select("id"), "id", "left_anti"))
