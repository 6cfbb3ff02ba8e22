"""Seat allocation over contests made of regions and nations (ALLOC)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostra.operators import allocation
from rostra.plans.civic import query, table

SEATS = 17


def contests(spark, sf):
    """Contests are regions, parties their nations, votes the orders of the nations' customers."""
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    v = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("n_regionkey").alias("contest"), F.col("n_name").alias("party")).agg(F.count("*").alias("votes"))
    return v.withColumn("seats", F.lit(SEATS))


VOTES = "v as (select n_regionkey as contest, n_name as party, count(*) as votes from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2)"


def quotients(adjusted: bool) -> str:
    divisor = "case when k = 0 then 1200000 else (2 * k + 1) * 1000000 end" if adjusted else "(k + 1) * 1000000"
    return f"""{VOTES}, q0 as (select *, {divisor} as divisor from v, range({SEATS}) r(k)),
 q as (select *, row_number() over (partition by contest order by votes::hugeint * 1000000 * 1000000000000000 // divisor desc, party, k) as seat from q0)"""


@query("highest_averages_dhondt", f"with {quotients(False)}, w as (select contest, party, count(*) as won from q where seat <= {SEATS} group by 1, 2) select contest, party, votes, coalesce(won, 0) as won from v left join w using (contest, party)")
def highest_averages_dhondt(spark, sf):  # ALLOC-04
    return allocation.allocate(contests(spark, sf), "contest", "party", "votes", "seats")


@query("highest_averages_adjusted", f"with {quotients(True)}, w as (select contest, party, count(*) as won from q where seat <= {SEATS} group by 1, 2) select contest, party, votes, coalesce(won, 0) as won from v left join w using (contest, party)")
def highest_averages_adjusted(spark, sf):  # ALLOC-03, ALLOC-04
    return allocation.allocate(contests(spark, sf), "contest", "party", "votes", "seats", allocation.ADJUSTED, "1,2")


@query("seat_steps", f"with {quotients(True)} select contest, cast(seat as integer) as seat, party, cast(divisor as bigint) as divisor from q where seat <= {SEATS}")
def seat_steps(spark, sf):  # ALLOC-05, WIN-11
    return allocation.seat_steps(contests(spark, sf), "contest", "party", "votes", "seats", allocation.ADJUSTED)


@query("needed_votes", f"""with {quotients(False)}, w as (select contest, party, count(*) as won from q where seat <= {SEATS} group by 1, 2), l as (select contest, party as winner, votes as lv, divisor as ld from q where seat = {SEATS}),
 a as (select contest, party, votes, coalesce(won, 0) as won from v left join w using (contest, party))
 select contest, party, cast(greatest(0, lv::hugeint * (won + 1) * 1000000 // ld - votes + 1) as bigint) as needed from a join l using (contest) where party <> winner""")
def needed_votes(spark, sf):  # ALLOC-09, SRT-06
    return allocation.needed_votes(contests(spark, sf), "contest", "party", "votes", "seats")


@query("last_seat_ties", f"""with {quotients(False).replace('from v,', 'from (select contest, party, votes // 400 as votes from v) v,')}, x as (select *, votes::hugeint * 1000000 * 1000000000000000 // divisor as quot from q), l as (select contest, quot as last from x where seat = {SEATS})
 select contest, count(*) filter (quot = last) as n_tied from x join l using (contest) group by contest having count(*) filter (quot = last) > {SEATS} - count(*) filter (quot > last)""")
def last_seat_ties(spark, sf):  # ALLOC-08
    few = contests(spark, sf).withColumn("votes", F.floor(F.col("votes") / 400))
    return allocation.last_seat_ties(few, "contest", "party", "votes", "seats")


@query("percent_largest_remainder", f"""with {VOTES}, t as (select *, sum(votes) over (partition by contest) as t from v), u as (select *, votes::hugeint * 100000000 // t as u, votes::hugeint * 100000000 % t as r from t),
 p as (select *, 100000000 - sum(u) over (partition by contest) as rest, row_number() over (partition by contest order by r desc, party) as place from u) select contest, party, cast(u + (place <= rest)::int as bigint) as units from p""")
def percent_largest_remainder(spark, sf):  # ALLOC-02, WIN-13
    return allocation.largest_remainder(contests(spark, sf), "contest", "party", "votes")


@query("allocation_shares", f"""with {quotients(False)}, w as (select contest, party, count(*) as won from q where seat <= {SEATS} group by 1, 2), a as (select contest, party, votes, coalesce(won, 0) as won from v left join w using (contest, party))
 select contest, party, votes, won, printf('%.2f%%', votes * 100.0::double / sum(votes) over (partition by contest)) as vote_share, printf('%.2f%%', won * 100.0::double / sum(won) over (partition by contest)) as seat_share from a""")
def allocation_shares(spark, sf):  # ALLOC-10, WIN-12, SRT-05
    return allocation.shares(allocation.allocate(contests(spark, sf), "contest", "party", "votes", "seats"), "contest", "party", "votes", "won")


def lots_sql(name: str, votes: str, seats: int, seed: str) -> str:
    """Recursive tables that give out seat after seat of each contest: whoever has the highest quotient wins, and several of them
    draw by the next state of the generator. Quotients are whole multiples of 1 / 12252240, which every divisor up to 18 divides."""
    shift = lambda s, n: f"(({s})::hugeint * {2**n} % 18446744073709551616)::ubigint"
    return f"""{name}_p as (select contest, list(party order by party) as ps, list({votes} order by party) as vs from v group by contest),
 {name} as (select contest, ps, vs, list_transform(vs, lambda x: 0) as won, list_transform(vs, lambda x: 0) as lots, {allocation.seed_state(seed)}::ubigint as s, 0 as seat from {name}_p
  union all select contest, ps, vs, list_transform(range(1, len(vs) + 1), lambda i: won[i] + (i = t[pick])::int), list_transform(range(1, len(vs) + 1), lambda i: lots[i] + (i = t[pick] and len(t) > 1)::int), s3, seat + 1
   from (select *, case when len(t) > 1 then 1 + (s3 % 1000000)::bigint * len(t) // 1000000 else 1 end as pick from (select *, case when len(t) > 1 then xor(s2, {shift("s2", 17)}) else s end as s3
    from (select *, xor(s1, s1 // 128) as s2 from (select *, xor(s, {shift("s", 13)}) as s1
     from (select *, list_filter(range(1, len(vs) + 1), lambda i: q[i] = list_max(q)) as t from (select *, list_transform(range(1, len(vs) + 1), lambda i: vs[i] * 12252240 // (won[i] + 1)) as q from {name} where seat < {seats}))))))),
 {name}_won as (select contest, unnest(ps) as party, unnest(won)::bigint as won, unnest(lots)::bigint as by_lot from {name} where seat = {seats})"""


@query("allocation_lottery", f"with recursive {VOTES}, {lots_sql('r', 'votes // 40', SEATS, '123456789')} select contest, party, won, by_lot from r_won")
def allocation_lottery(spark, sf):  # ALLOC-06; draws of a seeded generator
    return allocation.allocate_exact(contests(spark, sf).withColumn("votes", F.floor(F.col("votes") / 40)), "contest", "party", "votes", "seats", first="1.2", seed="123456789")


@query("members_and_substitutes", f"with recursive {VOTES}, {lots_sql('m', 'votes', SEATS, '123456789m')}, {lots_sql('e', 'votes', 11, '123456789e')} select contest, party, m_won.won as members, e_won.won as substitutes from m_won join e_won using (contest, party)")
def members_and_substitutes(spark, sf):  # ALLOC-07, JOIN-13
    return allocation.members_and_substitutes(contests(spark, sf).withColumn("more", F.lit(11)), "contest", "party", "votes", "seats", "more", "123456789")


@query("seats_as_votes", f"with {quotients(False)}, w as (select contest, count(*) filter (seat <= {SEATS} and party < 'NATION_2') as votes from q group by 1) select contest, votes from w")
def seats_as_votes(spark, sf):  # ALLOC-11: one allocation's seats are the next one's votes
    won = allocation.allocate(contests(spark, sf), "contest", "party", "votes", "seats")
    return won.groupBy("contest").agg(F.sum(F.when(F.col("party") < "NATION_2", F.col("won")).otherwise(0)).alias("votes"))


@query("contest_violations", f"with {VOTES} select contest, 'seats' as problem from (select distinct contest from v where contest = 1) union all select contest, 'negative_votes' from (select distinct contest from v where contest = 2) union all select contest, 'no_votes' from (select distinct contest from v where contest = 3)")
def contest_violations(spark, sf):  # ALLOC-01
    bad = contests(spark, sf).withColumn("seats", F.when(F.col("contest") == 1, 0).otherwise(F.col("seats")))
    odd = F.when((F.col("contest") == 2) & (F.col("party") == F.lit("NATION_2")), -1).when(F.col("contest") == 3, 0).otherwise(F.col("votes"))
    return allocation.violations(bad.withColumn("votes", odd), "contest", "votes", "seats")
