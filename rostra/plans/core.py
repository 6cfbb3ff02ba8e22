"""Filters, tallies, merges and joins (FLT, JOIN, AGG-01 to 04, 15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostra.functions import keys
from rostra.operators import facets, joins, votes, windows
from rostra.plans.civic import BALLOTS, POINTS, TALLY, ballots, points, query, table

SPEC = facets.FacetSpec({"party": ["BUILDING", "MACHINERY"], "kind": ["1-URGENT", "2-HIGH"], "body": []}, [("1996-12-31", "1995-01-01"), ("1998-03-01", "1998-03-31")])
SPEC_SQL = "party in ('BUILDING', 'MACHINERY') and kind in ('1-URGENT', '2-HIGH') and (date between date '1995-01-01' and date '1996-12-31' or date between date '1998-03-01' and date '1998-03-31')"


@query("ranked_faceted_points", f"""with {POINTS}, {BALLOTS}, t as (select id, {TALLY} from ballots group by id),
 p as (select p.*, coalesce(named, 0) as named, coalesce(yes, 0) as yes, coalesce(no, 0) as no, coalesce(abstain, 0) as abstain, coalesce(absent, 0) as absent, coalesce(rounds, 0) as rounds
   from points p left join t using (id) where {SPEC_SQL})
 select * from (select id, date::varchar as date, body, party, kind, result, named, yes, no, abstain, absent, rounds, cast(row_number() over (order by p.date desc, body desc, id desc) as integer) as rank from p) where rank <= 100""")
def ranked_faceted_points(spark, sf):  # FLT-01, FLT-02, JOIN-01, JOIN-02, AGG-01, SRT-02, SRT-08
    """Facets are applied before the join, and ballots reduced to the points that pass, before anything is counted."""
    kept = facets.faceted(points(spark, sf), SPEC).select("id", "date", "body", "party", "kind", "result")
    order = windows.ordered([(F.col("date"), False), (F.col("body"), False), (F.col("id"), False)], descending=True)
    best = windows.top_k(kept, order, 100)
    few = ballots(spark, sf).join(F.broadcast(best.select("id")), "id", "left_semi")  # 100 rows
    return votes.with_tally(best, votes.tally(few, ["id"]), ["id"]).withColumn("date", F.col("date").cast("string"))


@query("vote_tally_pivot", f"with {BALLOTS} select id, matter % 3 as point, {TALLY} from ballots group by all")
def vote_tally_pivot(spark, sf):  # AGG-01
    return votes.tally(ballots(spark, sf).withColumn("point", F.col("matter") % 3), ["id", "point"])


@query("faceted_points", f"with {POINTS} select * replace (date::varchar as date) from points where {SPEC_SQL}")
def faceted_points(spark, sf):  # FLT-01, FLT-09
    return facets.faceted(points(spark, sf), SPEC).withColumn("date", F.col("date").cast("string"))


@query("date_range_union", "select o_orderkey, o_custkey from orders where cast(o_orderdate as date) between date '1995-05-01' and date '1995-06-15' or cast(o_orderdate as date) between date '1997-01-01' and date '1997-01-31'")
def date_range_union(spark, sf):  # FLT-02, FLT-03
    dates = facets.in_ranges(F.col("o_orderdate").cast("date"), [("1997-01-01", "1997-01-31"), ("1995-06-15", "1995-05-01"), ("1995-05-01", "1995-06-15")])
    return table(spark, sf, "orders").where(dates).select("o_orderkey", "o_custkey")


@query("invalid_split", "select o_orderkey as id, case o_orderpriority when '5-LOW' then 'BLANK' when '4-NOT SPECIFIED' then 'OG' else o_orderpriority end in ('BLANK', 'OG', 'OGEJ') as invalid from orders")
def invalid_split(spark, sf):  # FLT-11
    code = keys.mapped(F.col("o_orderpriority"), {"5-LOW": "BLANK", "4-NOT SPECIFIED": "OG"})
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), facets.is_invalid(code).alias("invalid"))


@query("ballot_filter", f"with {BALLOTS} select id, seq, name, vote from ballots where party in ('P1', 'P2') and vote in ('Ja', 'Avstår') and name % 2 = 0")
def ballot_filter(spark, sf):  # FLT-05, FLT-06
    return ballots(spark, sf).where(facets.facet_predicate({"party": ["P1", "P2"], "vote": ["Ja", "Avstår"], "matter": []}) & (F.col("name") % 2 == 0)).select("id", "seq", "name", "vote")


@query("election_filter", "select c_custkey, n_name, c_mktsegment from customer join nation on c_nationkey = n_nationkey where n_regionkey in (1, 3) and c_mktsegment in ('BUILDING', 'FURNITURE') and contains(lower(c_name), '00001')")
def election_filter(spark, sf):  # FLT-04, FLT-13
    from rostra.functions.text import contains_all

    rows = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    shown = rows.where(facets.facet_predicate({"n_regionkey": [1, 3], "c_mktsegment": ["BUILDING", "FURNITURE"]}) & contains_all(F.col("c_name"), "00001"))
    return shown.drop("c_acctbal", "c_name", "c_nationkey", "n_nationkey", "n_regionkey").select("c_custkey", "n_name", "c_mktsegment")


@query("public_cutoff", "select event_id, strftime(ts, '%Y-%m-%d') >= '2023-01-01' and event_id % 2 = 0 as public from events")
def public_cutoff(spark, sf):  # FLT-12
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.lit("odd"))
    return table(spark, sf, "events").select("event_id", facets.is_public(text).alias("public"))


@query("line_predicates", """with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
 select doc_id, count(*) as n_lines, count(*) filter (trim(line) = '' or regexp_matches(lower(trim(line)), '^([a-zåäö]+ )?protokoll( digitalt justerat)?$') or regexp_matches(trim(line), '^[0-9]+ ?\\([0-9]+\\)$')) as n_ignorable,
   count(*) filter (regexp_matches(rtrim(line), '([,;:(-]| (och|att|som|för|av|the|of|and|de|la))$')) as n_truncated from l group by doc_id""")
def line_predicates(spark, sf):  # FLT-14, FLT-15
    from rostra.operators.extraction import lines

    each = lines(table(spark, sf, "documents"), ["doc_id"], "text")
    return each.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(keys.ignorable_line(F.col("line"))).alias("n_ignorable"), F.count_if(keys.looks_truncated(F.col("line"))).alias("n_truncated"))


STATED = "stated as (select o_orderkey as id, cast(o_custkey % 4 as bigint) as stated_yes, cast(o_custkey % 3 as bigint) as stated_no, cast(null as bigint) as stated_abstain, cast(0 as bigint) as stated_absent from orders)"


def stated(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 4).alias("stated_yes"), (F.col("o_custkey") % 3).alias("stated_no"), F.lit(None).cast("bigint").alias("stated_abstain"), F.lit(0).cast("bigint").alias("stated_absent"))


@query("stated_over_named", f"""with {BALLOTS}, {STATED}, t as (select id, {TALLY} from ballots group by id),
 m as (select s.id, coalesce(named, 0) as named, coalesce(rounds, 0) as rounds, coalesce(nullif(stated_yes, 0), yes, 0) as yes, coalesce(nullif(stated_no, 0), no, 0) as no,
   coalesce(nullif(stated_abstain, 0), abstain, 0) as abstain, coalesce(nullif(stated_absent, 0), absent, 0) as absent from stated s left join t using (id))
 select *, greatest(named, yes + no + abstain + absent) as voters from m""")
def stated_over_named(spark, sf):  # AGG-02, JOIN-02
    both = votes.merge_stated(votes.with_tally(stated(spark, sf), votes.tally(ballots(spark, sf), ["id"]), ["id"]))
    return both.select("id", "named", "rounds", *votes.COUNTERS, "voters")


@query("canonical_totals", f"""with {BALLOTS}, {STATED}, t as (select id, {TALLY} from ballots group by id),
 e as (select l_orderkey as id, cast(sum(l_linenumber) as bigint) as ey, cast(sum(l_quantity) as bigint) as en from lineitem group by 1),
 m as (select s.*, yes, no, abstain, absent, coalesce(case when stated_yes > 0 then stated_yes end, ey, 0) as y, coalesce(case when stated_no > 0 then stated_no end, en, 0) as n
   from stated s left join t using (id) left join e using (id))
 select id, case when y + n > 0 then y else coalesce(yes, 0) end as yes, case when y + n > 0 then n else coalesce(no, 0) end as no,
   case when y + n > 0 then 0 else coalesce(abstain, 0) end as abstain, case when y + n > 0 then 0 else coalesce(absent, 0) end as absent from m""")
def canonical_totals(spark, sf):  # AGG-03
    rows = votes.with_tally(stated(spark, sf), votes.tally(ballots(spark, sf), ["id"]), ["id"])
    events = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("bigint").alias("stated_yes"), F.col("l_quantity").cast("bigint").alias("stated_no"), F.lit(None).cast("bigint").alias("stated_abstain"), F.lit(None).cast("bigint").alias("stated_absent"))
    return votes.canonical_totals(rows, events, ["id"])


@query("vote_conflicts", f"""with {BALLOTS}, s as (select o_orderkey::varchar || ':F' as event, cast(1 + o_custkey % 3 as bigint) as sy, cast(o_custkey % 2 as bigint) as sn, cast(1 as bigint) as sa, cast(0 as bigint) as sb from orders),
 n as (select event, count(*) filter (vote = 'Ja') as ny, count(*) filter (vote = 'Nej') as nn, count(*) filter (vote = 'Avstår') as na, count(*) filter (vote = 'Frånvarande') as nb from ballots group by event),
 b as (select s.*, coalesce(ny, 0) as ny, coalesce(nn, 0) as nn, coalesce(na, 0) as na, coalesce(nb, 0) as nb from s left join n using (event)),
 c as (select *, ny > sy or nn > sn or na > sa or nb > sb as o from b), f as (select *, o and ny + nn + na + nb = sy + sn + sa + sb as x from c)
 select event, case when x then ny else sy end as stated_yes, case when x then nn else sn end as stated_no, case when x then na else sa end as stated_abstain, case when x then nb else sb end as stated_absent, o as count_conflict, x as reconciled from f""")
def vote_conflicts(spark, sf):  # AGG-04
    events = table(spark, sf, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(":F")).alias("event"), (1 + F.col("o_custkey") % 3).alias("stated_yes"), (F.col("o_custkey") % 2).alias("stated_no"), F.lit(1).cast("bigint").alias("stated_abstain"), F.lit(0).cast("bigint").alias("stated_absent"))
    return votes.mark_conflicts(events, ballots(spark, sf))


@query("ballots_by_group", f"with {BALLOTS} select event, vote, party, count(*) as n, string_agg(distinct name::varchar, '|' order by name::varchar) as names from ballots group by event, vote, party")
def ballots_by_group(spark, sf):  # AGG-15
    return votes.ballots_by_group(ballots(spark, sf))


def attendance(spark, sf):
    """Who was at which body's meetings: suppliers by nation."""
    return table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("meeting"), F.col("s_suppkey").alias("name"), F.concat(F.lit("P"), (F.col("s_suppkey") % 7).cast("string")).alias("party"), F.lit("member").alias("role"))


ATTENDANCE = "attendance as (select n_name as meeting, s_suppkey as name, 'P' || (s_suppkey % 7)::varchar as party, 'member' as role from supplier join nation on s_nationkey = n_nationkey)"


@query("participant_semi_join", f"""with {POINTS}, {BALLOTS}, {ATTENDANCE}
 select id, body, party from points p where exists (select 1 from ballots b where b.id = p.id and b.name in (3, 5, 7))
   or exists (select 1 from ballots b where b.id = p.id and b.seq = 1 and b.name in (3, 5, 7)) or exists (select 1 from attendance a where a.meeting = p.body and a.name in (3, 5, 7))""")
def participant_semi_join(spark, sf):  # JOIN-04, FLT-07, FLT-08
    p = points(spark, sf).withColumn("meeting", F.col("body"))
    b = ballots(spark, sf)
    return votes.filtered_points(p, b, b.where("seq = 1").select("id", "name", "party"), attendance(spark, sf), members=[3, 5, 7]).select("id", "body", "party")


@query("participant_votes", f"with {POINTS}, {BALLOTS} select id, kind from points p where exists (select 1 from ballots b where b.id = p.id and b.party = 'P3' and b.vote in ('Nej'))")
def participant_votes(spark, sf):  # JOIN-04 with votes asked for
    b = ballots(spark, sf)
    return votes.filtered_points(points(spark, sf).withColumn("meeting", F.col("body")), b, b.select("id", "name", "party"), attendance(spark, sf), parties=["P3"], votes=["Nej"]).select("id", "kind")


@query("attendance_prune", "select c_custkey, c_nationkey from customer c where exists (select 1 from supplier s where s.s_nationkey = c.c_nationkey and s_suppkey % 3 = 0)")
def attendance_prune(spark, sf):  # JOIN-05
    kept = table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("c_nationkey"))
    return joins.prune(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), kept, ["c_nationkey"])


@query("attendance_reconcile", f"""with {BALLOTS}, {ATTENDANCE}, v as (select distinct n_name as meeting, b.name, b.party from ballots b join nation n on n_nationkey = b.matter % 25 where vote <> 'Frånvarande' and seq = 1)
 select meeting, name, party, role from attendance union all select meeting, name, party, 'verified' as role from v where not exists (select 1 from attendance a where a.meeting = v.meeting and a.name = v.name and a.party = v.party)""")
def attendance_reconcile(spark, sf):  # JOIN-06
    b = ballots(spark, sf).where("seq = 1").join(F.broadcast(table(spark, sf, "nation")), F.col("n_nationkey") == F.col("matter") % 25).withColumnRenamed("n_name", "meeting")
    return joins.reconcile_attendance(attendance(spark, sf), b)


@query("orphan_fragments", """with p as (select p_type as meeting, p_brand as party, p_name as name, p_partkey % 2 = 0 as verified from part union all select p_type, p_brand, string_split(p_name, ' ')[-1], p_partkey % 5 = 0 from part where p_partkey % 3 = 0)
 select meeting, party, name from p where not contains(name, ' ') and not verified and exists (select 1 from p q where q.meeting = p.meeting and q.party = p.party and contains(q.name, ' ') and q.verified and string_split(q.name, ' ')[-1] = p.name)""")
def orphan_fragments(spark, sf):  # JOIN-07
    part = table(spark, sf, "part")
    full = part.select(F.col("p_type").alias("meeting"), F.col("p_brand").alias("party"), F.col("p_name").alias("name"), (F.col("p_partkey") % 2 == 0).alias("verified"))
    cut = part.where("p_partkey % 3 = 0").select("p_type", "p_brand", F.element_at(F.split("p_name", " "), -1), F.col("p_partkey") % 5 == 0)
    return joins.orphan_fragments(full.union(cut))


@query("metadata_corrections", "select o_orderkey, case when o_orderkey % 10 = 0 then 'X' else o_orderstatus end as o_orderstatus, case when o_orderkey % 10 = 0 then coalesce(case when o_orderkey % 20 = 0 then 'fixed' end, o_orderpriority) else o_orderpriority end as o_orderpriority from orders")
def metadata_corrections(spark, sf):  # JOIN-08
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    fixes = o.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 20 == 0, "fixed").alias("o_orderpriority"))
    return joins.corrected(o, fixes, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("diary_lookup", "select o_orderkey, coalesce(case when c_custkey % 2 = 0 then c_name end, n_name) as diary from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
def diary_lookup(spark, sf):  # JOIN-09, JOIN-10
    c = table(spark, sf, "customer")
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(c.select("c_custkey", "c_nationkey"), "c_custkey")
    by_url = c.where("c_custkey % 2 = 0").select("c_custkey", F.col("c_name").alias("diary"))
    by_title = F.broadcast(table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("diary")))
    return joins.coalesced_lookup(rows, [(by_url, "c_custkey"), (by_title, "c_nationkey")], "diary").select("o_orderkey", "diary")


@query("point_details", f"with {POINTS}, {BALLOTS} select p.id, p.body, b.seq, b.name, b.vote from points p join ballots b using (id)")
def point_details(spark, sf):  # JOIN-03, JOIN-11
    return points(spark, sf).select("id", "body").join(ballots(spark, sf).select("id", "seq", "name", "vote"), "id")


@query("new_links_antijoin", "select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def new_links_antijoin(spark, sf):  # JOIN-14, STR-06, SRC-08
    return joins.new_only(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), ["doc_id"])


@query("page_to_source", """with r as (select user_id as doc, event_id as rng, cast(floor(value) as bigint) as b, cast(floor(value) as bigint) + event_id % 40 as e from events),
 p as (select distinct l_suppkey as doc, cast(l_quantity as bigint) as page from lineitem)
 select p.doc, p.page, coalesce(min(r.rng), -1) as rng from p left join r on r.doc = p.doc and p.page between r.b and r.e group by 1, 2""")
def page_to_source(spark, sf):  # JOIN-16
    ranges = table(spark, sf, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("rng"), F.expr("cast(floor(value) as bigint)").alias("b"), F.expr("cast(floor(value) as bigint) + event_id % 40").alias("e"))
    pages = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_quantity").cast("bigint").alias("page")).distinct()
    return joins.range_first(pages, ranges, "doc", "page", "b", "e", "rng", width=16).fillna(-1, ["rng"])


@query("forward_asof", """with l as (select event_id, user_id, cast(ts as date) as day from events where event_type = 'click'), r as (select user_id, cast(ts as date) as day, max(event_id) as target from events where event_type = 'purchase' group by 1, 2)
 select event_id, user_id, day::varchar as day, coalesce((select arg_min(target, r.day) from r where r.user_id = l.user_id and r.day >= l.day), -1) as target from l""")
def forward_asof(spark, sf):  # JOIN-17, REF-06
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("date").alias("day"), "event_type")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "day").agg(F.max("event_id").alias("target"))
    return joins.forward_asof(e.where("event_type = 'click'").drop("event_type"), right, ["user_id"], "day", "day", "target").withColumn("day", F.col("day").cast("string")).fillna(-1, ["target"])


@query("page_signature_match", """with s as (select conv_id, turn, sha256(text) as h from conversations), want as (select conv_id as w, turn as t, h, count(*) over (partition by conv_id) as n from s)
 select w as part, s.conv_id as found, s.turn - want.t as shift from want join s on s.h = want.h group by w, s.conv_id, s.turn - want.t, n having count(*) = n""")
def page_signature_match(spark, sf):  # JOIN-18
    s = table(spark, sf, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("h"))
    return joins.runs_found(s, "conv_id", "turn", "h")


@query("meeting_sections_sets", """with a as (select o_custkey as k, list(distinct o_orderpriority) as a from orders where o_orderkey % 2 = 0 group by 1), b as (select o_custkey as k, list(distinct o_orderpriority) as b from orders where o_orderkey % 3 = 0 group by 1),
 j as (select a.k, a, coalesce(b, []) as b from a left join b using (k))
 select k, cast(len(list_intersect(a, b)) as integer) as common, cast(len(a) - len(list_intersect(a, b)) as integer) as added, cast(len(b) - len(list_intersect(a, b)) as integer) as missing,
   case when len(b) = 0 then 'pending' when len(list_intersect(a, b)) = 0 then 'conflict' when len(a) > len(list_intersect(a, b)) then 'supplement' else 'known' end as state from j""")
def meeting_sections_sets(spark, sf):  # JOIN-15, SET-02, SET-03, SET-04
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderpriority")
    return joins.section_sets(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"), "k", "o_orderpriority")
