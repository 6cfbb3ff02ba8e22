"""Proportional seat allocation with exact quotients."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Divisors are scaled by this, so that first divisors have up to six decimals.
SCALE = 1_000_000
#: 100 percent in units of 10**-6 percent.
PERCENT_UNITS = 100 * SCALE
DHONDT, ADJUSTED = "dhondt", "adjusted"


def divisor(method: str, k: Column, first: str = "1.2") -> Column:
    """The divisor for a party's seat k (from 0), scaled: 1, 2, 3 ... or first, 3, 5, 7 ..."""
    if method == DHONDT:
        return (k + 1) * SCALE
    return F.when(k == 0, int(Fraction(first.replace(",", ".")) * SCALE)).otherwise((2 * k + 1) * SCALE).cast("bigint")


def quotients(parties: DataFrame, contest: str, party: str, votes: str, seats: str, method: str = DHONDT, first: str = "1.2") -> DataFrame:
    """All quotients that can win a seat, as exact decimals, ranked within the contest (ties by ``party``).

    A party can win at most ``seats`` of them, so each has that many rows.
    """
    each = parties.withColumn("k", F.explode(F.sequence(F.lit(0), F.col(seats) - 1)))
    div = each.withColumn("divisor", divisor(method, F.col("k"), first))
    q = div.withColumn("quotient", F.col(votes).cast("decimal(12,0)") * F.lit(SCALE).cast("decimal(7,0)") / F.col("divisor").cast("decimal(20,0)"))
    return q.withColumn("seat", F.row_number().over(W.partitionBy(contest).orderBy(F.desc("quotient"), party, "k")))


def allocate(parties: DataFrame, contest: str, party: str, votes: str, seats: str, method: str = DHONDT, first: str = "1.2") -> DataFrame:
    """(contest, party, votes, seats won) by highest averages, where divisors grow; ties go to the smaller party.

    Equal to giving out seats one by one. For a first divisor above 3, use ``allocate_exact``.
    """
    won = quotients(parties, contest, party, votes, seats, method, first).where(F.col("seat") <= F.col(seats)).groupBy(contest, party).agg(F.count("*").alias("won"))
    return parties.join(won, [contest, party], "left").select(contest, party, votes, F.coalesce("won", F.lit(0)).alias("won"))


def seat_steps(parties: DataFrame, contest: str, party: str, votes: str, seats: str, method: str = DHONDT, first: str = "1.2") -> DataFrame:
    """(contest, seat, party, divisor): who wins each seat, in order."""
    return quotients(parties, contest, party, votes, seats, method, first).where(F.col("seat") <= F.col(seats)).select(contest, "seat", party, "divisor")


def needed_votes(parties: DataFrame, contest: str, party: str, votes: str, seats: str, method: str = DHONDT, first: str = "1.2") -> DataFrame:
    """(contest, party, needed): votes by which each party misses the contest's last seat, for all but its winner.

    Integers only: the last quotient is votes over divisor, and the next divisor of the other party scales it.
    """
    all_q = quotients(parties, contest, party, votes, seats, method, first)
    last = all_q.where(F.col("seat") == F.col(seats)).select(contest, F.col(party).alias("winner"), F.col(votes).alias("last_votes"), F.col("divisor").alias("last_divisor"))
    won = allocate(parties, contest, party, votes, seats, method, first)
    own = divisor(method, F.col("won"), first)
    gap = F.expr("div(cast(last_votes as decimal(18,0)) * cast(own as decimal(18,0)), cast(last_divisor as decimal(18,0)))").cast("bigint")
    both = won.join(last, contest).where(F.col(party) != F.col("winner")).withColumn("own", own)
    return both.select(contest, party, F.greatest(F.lit(0).cast("bigint"), gap - F.col(votes) + 1).alias("needed"))


def last_seat_ties(parties: DataFrame, contest: str, party: str, votes: str, seats: str, method: str = DHONDT, first: str = "1.2") -> DataFrame:
    """(contest, n_tied): parties whose quotient equals the last seat's, where more of them than seats are left."""
    q = quotients(parties, contest, party, votes, seats, method, first)
    last = q.where(F.col("seat") == F.col(seats)).select(contest, F.col("quotient").alias("last"))
    both = q.join(last, contest).groupBy(contest, seats).agg(F.count_if(F.col("quotient") > F.col("last")).alias("above"), F.count_if(F.col("quotient") == F.col("last")).alias("n_tied"))
    return both.where(F.col("n_tied") > F.col(seats) - F.col("above")).select(contest, "n_tied")


def largest_remainder(df: DataFrame, group: str, item: str, weight: str, target: int = PERCENT_UNITS) -> DataFrame:
    """(group, item, units): integers in proportion to the weights that add up to ``target``; leftovers go to the largest
    remainders, ties to the smaller item. Weights are integers; groups without weight share alike."""
    total = F.sum("w").over(W.partitionBy(group))
    some = df.select(group, item, F.greatest(F.lit(0), F.coalesce(weight, F.lit(0))).cast("bigint").alias("w"))
    some = some.withColumn("w", F.when(total == 0, 1).otherwise(F.col("w"))).withColumn("t", F.sum("w").over(W.partitionBy(group)))
    quota = some.withColumn("u", F.expr(f"div(cast(w as decimal(20,0)) * {target}, cast(t as decimal(18,0)))").cast("bigint"))
    quota = quota.withColumn("r", F.col("w").cast("decimal(20,0)") * target - F.col("u").cast("decimal(20,0)") * F.col("t").cast("decimal(18,0)"))
    left = F.lit(target) - F.sum("u").over(W.partitionBy(group))
    place = F.row_number().over(W.partitionBy(group).orderBy(F.desc("r"), item))
    return quota.withColumn("left", left).withColumn("place", place).select(group, item, (F.col("u") + (F.col("place") <= F.col("left")).cast("int")).alias("units"))


def seed_state(seed: str) -> int:
    """A 64-bit state from the seed's UTF-16 code units."""
    state, raw = 0, (seed or "1").encode("utf-16-le")
    for i in range(0, len(raw), 2):
        state = (state * 131 + int.from_bytes(raw[i : i + 2], "little")) % 2**64
    return state or 1


class Draws:
    """Numbers from 0 to below 1 in steps of 10**-6, by shifts and exclusive ors of a 64-bit state."""

    def __init__(self, seed: str):
        self.state = seed_state(seed)

    def next(self) -> float:
        for shift in (13, -7, 17):
            moved = self.state << shift if shift > 0 else self.state >> -shift
            self.state = (self.state ^ moved) % 2**64
        return self.state % SCALE / SCALE


def allocate_contest(parties: Sequence[tuple[str, int]], seats: int, method: str, first: str, seed: str) -> tuple[list[int], list[tuple[int, str, bool]]]:
    """Seats of each party, and (seat, winner, by lot) in order. Parties with the highest quotient draw lots, one draw for each such seat.

    A heap holds every party's next quotient, so a seat costs a logarithm of the parties.
    """
    start, draws, won, steps = Fraction(first.replace(",", ".")), Draws(seed), [0] * len(parties), []
    over = lambda k: Fraction(k + 1) if method == DHONDT else start if k == 0 else Fraction(2 * k + 1)
    heap = [(-Fraction(votes) / over(0), i) for i, (_, votes) in enumerate(parties)]
    heapq.heapify(heap)
    for seat in range(1, seats + 1):
        tied = [heapq.heappop(heap)]
        while heap and heap[0][0] == tied[0][0]:
            tied.append(heapq.heappop(heap))
        pick = int(draws.next() * len(tied)) if len(tied) > 1 else 0
        winner = tied.pop(pick)[1]
        steps.append((seat, parties[winner][0], bool(tied)))
        won[winner] += 1
        for t in [*tied, (-Fraction(parties[winner][1]) / over(won[winner]), winner)]:
            heapq.heappush(heap, t)
    return won, steps


def allocate_exact(parties: DataFrame, contest: str, party: str, votes: str, seats: str, method: str = DHONDT, first: str = "1.2", seed: str = "1") -> DataFrame:
    """(contest, party, won, by_lot) with lots for ties; any first divisor. A group has a contest's parties only."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(party)
        won, steps = allocate_contest(list(zip(pdf[party], pdf[votes].astype(int), strict=True)), int(pdf[seats].iloc[0]), method, first, seed)
        lots = [sum(by_lot for _, w, by_lot in steps if w == p) for p in pdf[party]]
        return pd.DataFrame({contest: pdf[contest], party: pdf[party], "won": won, "by_lot": lots})

    kinds = {f.name: f.dataType.simpleString() for f in parties.schema}
    return parties.groupBy(contest).applyInPandas(work, f"{contest} {kinds[contest]}, {party} {kinds[party]}, won bigint, by_lot bigint")


def members_and_substitutes(parties: DataFrame, contest: str, party: str, votes: str, members: str, substitutes: str, seed: str = "1") -> DataFrame:
    """Two independent runs, their seeds told apart by a suffix."""
    a = allocate_exact(parties, contest, party, votes, members, seed=seed + "m").select(contest, party, F.col("won").alias("members"))
    b = allocate_exact(parties, contest, party, votes, substitutes, seed=seed + "e").select(contest, party, F.col("won").alias("substitutes"))
    return a.join(b, [contest, party])


def violations(parties: DataFrame, contest: str, votes: str, seats: str, percent: bool = False) -> DataFrame:
    """(contest, problem) of contests that cannot be allocated."""
    sums = parties.groupBy(contest).agg(F.max(seats).alias("s"), F.min(votes).alias("low"), F.sum(votes).alias("total"), F.max((F.col(votes) % 1 != 0).cast("int")).alias("odd"))
    checks = [(~F.col("s").between(1, 10_000), "seats"), (F.col("low") < 0, "negative_votes"), (F.col("total") <= 0, "no_votes")]
    checks.append((F.col("total") > 100, "above_100_percent") if percent else (F.col("odd") == 1, "fractional_votes"))
    found = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(p)) for c, p in checks]))).alias("problem")
    return sums.select(contest, found)


def shares(result: DataFrame, contest: str, party: str, votes: str, won: str) -> DataFrame:
    """Votes and seats as percent texts of their contest's totals."""
    w = W.partitionBy(contest)
    text = lambda c: F.when(F.sum(c).over(w) != 0, F.format_string("%.2f%%", F.col(c) * 100.0 / F.sum(c).over(w))).otherwise("0.00%")
    return result.select(contest, party, votes, won, text(votes).alias("vote_share"), text(won).alias("seat_share"))


def counts_from_percent(percent: Column, basis: int) -> Column:
    """Votes that the percents stand for, with six decimals."""
    return F.round(F.greatest(F.lit(0.0), percent) * basis / 100.0, 6)
