"""Election results: party totals, turnout, eligible and invalid votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostra.operators.facets import is_invalid


def party_totals(rows: DataFrame, party: str = "party", votes: str = "votes") -> DataFrame:
    """Votes by party, most votes first; ties by name."""
    totals = rows.groupBy(party).agg(F.sum(votes).alias("votes"))
    return totals.withColumn("place", F.row_number().over(W.orderBy(F.desc("votes"), party)))


def turnout(rows: DataFrame, contest: Sequence[str], order: str, by: Sequence[str] = ()) -> DataFrame:
    """Totals that are repeated on every row of a contest, summed once per contest.

    The contest's first row (by ``order``) counts. Participation is cast over eligible, or the first contest's own percent.
    """
    first = F.min_by(F.struct("cast", "valid", "eligible", "percent"), F.col(order)).alias("f")
    once = rows.groupBy(*dict.fromkeys([*by, *contest])).agg(first, F.min(order).alias("o")).select("*", "f.*")
    sums = once.groupBy(*by).agg(F.sum("cast").alias("cast"), F.sum("valid").alias("valid"), F.sum("eligible").alias("eligible"), F.min_by("percent", "o").alias("p"))
    return sums.withColumn("participation", F.when(F.col("eligible") > 0, F.col("cast") / F.col("eligible") * 100.0).otherwise(F.coalesce("p", F.lit(0.0)))).drop("p")


def eligible_total(rows: DataFrame, by: Sequence[str], valid: str = "valid", votes: str = "votes", percent: str = "percent") -> DataFrame:
    """Valid votes where known; otherwise the largest party's votes scaled up by its percent, which may be a fraction."""
    top = rows.groupBy(*by).agg(F.max(valid).alias("v"), F.max(F.struct(F.col(votes).alias("n"), F.col(percent).alias("p"))).alias("t")).select(*by, "v", "t.*")
    scale = F.when(F.col("p") > 1, 100).otherwise(1)
    guess = F.when(F.coalesce(F.col("p") > 0, F.lit(False)), F.ceil(F.col("n") * scale / F.col("p"))).otherwise(F.col("n"))
    return top.select(*by, F.when(F.col("v") > 0, F.col("v")).otherwise(F.coalesce(guess, F.lit(0))).cast("bigint").alias("eligible_votes"))


def invalid_total(rows: DataFrame, by: Sequence[str], party: str = "party", votes: str = "votes") -> DataFrame:
    """Cast minus valid where both are known, else the invalid rows' votes; never below zero."""
    sums = rows.groupBy(*by).agg(F.max("cast").alias("c"), F.max("valid").alias("v"), F.sum(F.when(is_invalid(F.col(party)), F.col(votes)).otherwise(0)).alias("i"))
    known = (F.coalesce("c", F.lit(0)) != 0) & (F.coalesce("v", F.lit(0)) != 0)
    return sums.select(*by, F.greatest(F.lit(0), F.when(known, F.col("c") - F.col("v")).otherwise(F.col("i"))).cast("bigint").alias("invalid_votes"))


def draft_totals(drafts: DataFrame, totals: DataFrame, item: str = "item", members: str = "members", stored: str = "stored") -> DataFrame:
    """Drafted groups of parties with their members' current votes; what was stored, where these are missing or zero."""
    each = drafts.select(item, F.explode_outer(F.array_distinct(members)).alias("party"))
    sums = each.join(totals.select("party", "votes"), "party", "left").groupBy(item).agg(F.sum("votes").alias("v"))
    return drafts.join(sums, item, "left").select(item, F.coalesce(F.when(F.col("v") != 0, F.col("v")), F.col(stored)).alias("votes"))
