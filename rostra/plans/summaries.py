"""Aggregations, windows, sorts and pages (AGG-05 to 20, WIN, SRT, SNK-02, 04, 09)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostra.operators import elections, facets, meetings, quality, votes, windows
from rostra.plans.civic import BALLOTS, POINTS, ballots, points, query, table
from rostra.sources import sinks

#: Elections: a customer's orders are a party's results in a contest (nation, order year).
RESULTS = """results as (select n_regionkey as region, n_name as contest, year(o_orderdate) as year, case when c_mktsegment = 'FURNITURE' then 'BLANK' else c_mktsegment end as party, cast(floor(o_totalprice) as bigint) as votes, o_orderkey as ord,
  cast(1000 + n_nationkey * 10 as bigint) as cast_, cast(900 + n_nationkey * 9 as bigint) as valid_, cast(2000 + n_nationkey * 7 as bigint) as eligible_, cast(c_custkey % 50 as double) / 100 as percent_
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""


def results(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("n_regionkey").alias("region"), F.col("n_name").alias("contest"), F.year("o_orderdate").alias("year"), F.when(F.col("c_mktsegment") == "FURNITURE", "BLANK").otherwise(F.col("c_mktsegment")).alias("party"),
        F.floor("o_totalprice").alias("votes"), F.col("o_orderkey").alias("ord"), (1000 + F.col("n_nationkey") * 10).cast("bigint").alias("cast"), (900 + F.col("n_nationkey") * 9).cast("bigint").alias("valid"),
        (2000 + F.col("n_nationkey") * 7).cast("bigint").alias("eligible"), ((F.col("c_custkey") % 50).cast("double") / 100).alias("percent"),
    )


@query("party_totals", f"with {RESULTS} select party, cast(sum(votes) as bigint) as votes, cast(row_number() over (order by sum(votes) desc, party) as integer) as place from results group by party")
def party_totals(spark, sf):  # AGG-05
    return elections.party_totals(results(spark, sf))


@query("turnout_sum_once", f"""with {RESULTS}, f as (select region, year, contest, arg_min(cast_, ord) as c, arg_min(valid_, ord) as v, arg_min(eligible_, ord) as e from results group by 1, 2, 3)
 select region, cast(sum(c) as bigint) as cast_votes, cast(sum(v) as bigint) as valid_votes, cast(sum(e) as bigint) as eligible_voters, round(sum(c) / sum(e) * 100.0, 6) as participation from f group by region""")
def turnout_sum_once(spark, sf):  # AGG-06, WIN-03
    out = elections.turnout(results(spark, sf), ["year", "contest"], "ord", ["region"])
    return out.select("region", F.col("cast").alias("cast_votes"), F.col("valid").alias("valid_votes"), F.col("eligible").alias("eligible_voters"), F.round("participation", 6).alias("participation"))


@query("eligible_total", f"""with {RESULTS}, t as (select contest, max(case when region < 2 then valid_ else 0 end) as v, max({{'n': votes, 'p': percent_}}) as t from results group by contest)
 select contest, cast(case when v > 0 then v when t.p > 0 then ceil(t.n * case when t.p > 1 then 100 else 1 end / t.p) else t.n end as bigint) as eligible_votes from t""")
def eligible_total(spark, sf):  # AGG-07
    return elections.eligible_total(results(spark, sf).withColumn("valid", F.when(F.col("region") < 2, F.col("valid")).otherwise(0)), ["contest"])


@query("invalid_total", f"""with {RESULTS} select contest, cast(greatest(0, case when max(case when region < 2 then valid_ else 0 end) <> 0 then max(cast_) - max(valid_) else sum(case when party = 'BLANK' then votes else 0 end) end) as bigint) as invalid_votes from results group by contest""")
def invalid_total(spark, sf):  # AGG-08
    return elections.invalid_total(results(spark, sf).withColumn("valid", F.when(F.col("region") < 2, F.col("valid")).otherwise(0)), ["contest"])


@query("draft_totals", f"""with {RESULTS}, t as (select party, sum(votes) as votes from results group by party),
 d as (select * from (values ('left', ['BUILDING', 'MACHINERY', 'BUILDING'], 5), ('none', ['NOBODY'], 17), ('empty', cast([] as varchar[]), 3)) as v(item, members, stored))
 select item, cast(coalesce(nullif((select sum(votes) from t where list_contains(d.members, t.party)), 0), stored) as bigint) as votes from d""")
def draft_totals(spark, sf):  # JOIN-12, ALLOC-12
    drafts = spark.createDataFrame([("left", ["BUILDING", "MACHINERY", "BUILDING"], 5), ("none", ["NOBODY"], 17), ("empty", [], 3)], "item string, members array<string>, stored bigint")
    return elections.draft_totals(drafts, elections.party_totals(results(spark, sf)))


@query("decision_summary", f"""with {POINTS}, v as (select count(distinct event) as vote_events from (select l_orderkey::varchar || ':' || l_linestatus as event from lineitem where l_orderkey in (select id from points)))
 select count(*) as n_rows, count(distinct matter) as matters, count(distinct body || date::varchar) as meetings, count(distinct body || date::varchar || matter::varchar || id::varchar) as decisions, any_value(vote_events) as vote_events from points, v""")
def decision_summary(spark, sf):  # AGG-09
    rows = points(spark, sf).withColumn("meeting", F.concat("body", F.col("date").cast("string")))
    return meetings.decision_summary(rows, point="id", events=ballots(spark, sf).select("id", "event").join(rows.select("id"), "id", "left_semi"))


@query("split_vote_ids", """with v as (select p_partkey, case when p_partkey % 7 = 0 then null when p_partkey % 5 = 0 then ' , ' else 'e' || (p_partkey % 4)::varchar || ', ' || p_brand || ' ,e' || (p_partkey % 3)::varchar || ',' end as csv from part)
 select p_partkey, unnest(list_filter(list_transform(string_split(csv, ','), lambda x: trim(x)), lambda x: x <> '')) as event from v""")
def split_vote_ids(spark, sf):  # PRJ-02
    k = F.col("p_partkey")
    csv = F.when(k % 7 == 0, F.lit(None)).when(k % 5 == 0, " , ").otherwise(F.concat(F.lit("e"), (k % 4).cast("string"), F.lit(", "), F.col("p_brand"), F.lit(" ,e"), (k % 3).cast("string"), F.lit(",")))
    return table(spark, sf, "part").select(k, F.explode(votes.split_ids(csv)).alias("event"))


@query("document_summary", "select count(*) as n_documents, count(distinct lang) as n_types, count(*) filter (doc_id % 3 = 0) as n_dated, count(*) filter (quality is not null) as n_summarized from documents left join labels using (doc_id)")
def document_summary(spark, sf):  # AGG-10
    docs = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return meetings.document_summary(docs, "lang", F.col("doc_id") % 3 == 0, F.col("quality").isNotNull())


@query("meeting_rollup", f"""with {POINTS}, a as (select n_name as body, count(distinct s_suppkey) as n_present from supplier join nation on s_nationkey = n_nationkey group by 1)
 select body, count(distinct id) as n_decisions, count(distinct matter) as n_matters, coalesce(any_value(n_present), 0) as n_present, arg_min(id, row(date, id)) as first from points left join a using (body) group by body""")
def meeting_rollup(spark, sf):  # AGG-11
    present = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("body"), F.col("s_suppkey").alias("name"))
    return meetings.meeting_rollup(points(spark, sf), ["body"], "id", "matter", present, first_by=["date", "id"])


@query("meeting_search_text", "select user_id, string_agg(event_type, ' ' order by event_id) as rolled from events group by user_id")
def meeting_search_text(spark, sf):  # AGG-12
    return meetings.rolled_text(table(spark, sf, "events"), ["user_id"], "event_id", "event_type")


@query("facet_dictionary", "select facet, min(value) as value, count(*) as n from (unpivot (select p_type, lower(p_brand) as p_brand, case when p_partkey % 2 = 0 then upper(p_name) else p_name end as p_name from part) on p_type, p_brand, p_name into name facet value value) group by facet, lower(value)")
def facet_dictionary(spark, sf):  # AGG-13, SET-01, SET-05, SET-06, SNK-04
    rows = table(spark, sf, "part").select("p_type", F.lower("p_brand").alias("p_brand"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"))
    return facets.facet_values(rows, ["p_type", "p_brand", "p_name"])


@query("facet_cascade", f"with {POINTS} select body, count(*) as n from points where party = 'BUILDING' and kind in ('5-LOW') group by body")
def facet_cascade(spark, sf):  # AGG-14
    return facets.cascading_values(points(spark, sf), "body", {"party": ["BUILDING"], "kind": ["5-LOW"], "body": ["NATION_1"]})


CHOICES = {"body": ["NATION_1", "NATION_2", "NATION_5"], "party": ["BUILDING", "MACHINERY"], "kind": ["1-URGENT", "5-LOW"], "result": ["F", "O"], "member": [], "year": ["1995", "1996", "1997"]}


@query("facet_cascade_all", f"""with {POINTS}, r as (select body, party, kind, result, member, year(date)::varchar as year from points),
 m as (select *, body in ('NATION_1', 'NATION_2', 'NATION_5') as a, party in ('BUILDING', 'MACHINERY') as b, kind in ('1-URGENT', '5-LOW') as c, result in ('F', 'O') as d, year in ('1995', '1996', '1997') as e from r)
 select 'body' as facet, body as value, count(*) as n from m where b and c and d and e group by body union all select 'party', party, count(*) from m where a and c and d and e group by party union all select 'kind', kind, count(*) from m where a and b and d and e group by kind
 union all select 'result', result, count(*) from m where a and b and c and e group by result union all select 'member', member, count(*) from m where a and b and c and d and e group by member union all select 'year', year, count(*) from m where a and b and c and d group by year""")
def facet_cascade_all(spark, sf):  # AGG-14: six facets, one scan
    p = points(spark, sf).withColumn("year", F.year("date").cast("string"))
    return facets.cascading_values_all(p, list(CHOICES), CHOICES)


@query("stance_groups", f"""with {BALLOTS}, p as (select id % 100 as point, name, party, case vote when 'Ja' then 'Bifallsyrkande' when 'Nej' then 'Avslagsyrkande' else 'Annat' end as stance from ballots)
 select point, stance, count(distinct name::varchar || party) as n, case stance when 'Bifallsyrkande' then 1 when 'Avslagsyrkande' then 2 else 6 end as stance_rank from p group by 1, 2""")
def stance_groups(spark, sf):  # AGG-16
    stance = F.when(F.col("vote") == "Ja", "Bifallsyrkande").when(F.col("vote") == "Nej", "Avslagsyrkande").otherwise("Annat")
    return meetings.stance_groups(ballots(spark, sf).withColumn("stance", stance).withColumn("point", F.col("id") % 100), ["point"])


@query("attendance_by_role", f"""with {BALLOTS}, a as (select distinct matter % 40 as meeting, name, party, vote as role from ballots)
 select meeting, case role when 'Ja' then 'members' when 'Nej' then 'substitutes' else 'others' end as role_group, count(*) as n from a group by 1, 2""")
def attendance_by_role(spark, sf):  # AGG-17
    group = F.when(F.col("role") == "Ja", "members").when(F.col("role") == "Nej", "substitutes").otherwise("others")
    return meetings.attendance_by_role(ballots(spark, sf).withColumnRenamed("vote", "role").withColumn("meeting", F.col("matter") % 40), ["meeting"], group)


@query("pack_header", "select min(cast(ts as date))::varchar as pf, max(cast(ts as date))::varchar as pt, count(*) as n_documents, count(*) filter (event_type = 'click') as n_votes, count(*) filter (event_type = 'view') as n_positions, count(*) filter (event_type = 'signup') as n_members from events")
def pack_header(spark, sf):  # AGG-19
    day = F.col("ts").cast("date")
    count = lambda kind: F.count_if(F.col("event_type") == kind)
    return table(spark, sf, "events").agg(F.min(day).cast("string").alias("pf"), F.max(day).cast("string").alias("pt"), F.count("*").alias("n_documents"), count("click").alias("n_votes"), count("view").alias("n_positions"), count("signup").alias("n_members"))


@query("duplicate_groups", """select h as same, doc_id, copies from (select sha256(text) as h, doc_id, count(*) over (partition by sha256(text)) as copies, row_number() over (partition by sha256(text) order by source, doc_id) as r from documents) where r = 1 and copies > 1""")
def duplicate_groups(spark, sf):  # AGG-20, DQ-09
    docs = table(spark, sf, "documents").select(F.sha2("text", 256).alias("same"), "source", "doc_id")
    return quality.best_copy(docs, "same", ["source", "doc_id"]).where("copies > 1").select("same", "doc_id", "copies")


@query("representative_row", """select n_name as body, c_custkey, title, attendees from (select n_name, c_custkey, case when c_custkey % 2 = 0 then '§ ' else '' end || c_name as title, c_nationkey * 0 + c_custkey % 5 as attendees,
  row_number() over (partition by n_name order by c_custkey % 5 desc, (c_custkey % 2 = 0)::int, case when c_custkey % 2 = 0 then '§ ' else '' end || c_name) as r from customer join nation on c_nationkey = n_nationkey) where r = 1""")
def representative_row(spark, sf):  # WIN-02
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(F.col("n_name").alias("body"), "c_custkey", F.concat(F.when(F.col("c_custkey") % 2 == 0, "§ ").otherwise(""), "c_name").alias("title"), (F.col("c_custkey") % 5).alias("attendees"))
    return meetings.representative(rows, ["body"], "attendees", "title")


@query("id_disambiguation", "select event_id, user_id, case when row_number() over (partition by user_id order by event_id) = 1 then user_id::varchar else user_id::varchar || '__source_' || event_id::varchar end as unique_id from events")
def id_disambiguation(spark, sf):  # PRJ-20, WIN-01
    return windows.disambiguated(table(spark, sf, "events").select("event_id", "user_id"), "user_id", "event_id")


@query("last_wins_dedupe", "select user_id, min(event_id) as first_position, arg_max(event_type, event_id) as event_type, arg_max(round(value, 2), event_id) as value from events group by user_id")
def last_wins_dedupe(spark, sf):  # WIN-04
    return windows.last_wins(table(spark, sf, "events").select("user_id", "event_id", "event_type", F.round("value", 2).alias("value")), ["user_id"], "event_id").drop("event_id")


@query("preferred_spelling", "select p_type, p_name, n from (select *, row_number() over (partition by p_type order by n desc, length(p_name) desc, p_name) as r from (select p_type, p_name, count(*) as n from part group by 1, 2)) where r = 1")
def preferred_spelling(spark, sf):  # WIN-05
    return windows.most_frequent(table(spark, sf, "part"), "p_type", "p_name")


@query("gaps_islands", "select l_suppkey, min(d) as begin, count(*) as length from (select l_suppkey, d, d - row_number() over (partition by l_suppkey order by d) as i from (select distinct l_suppkey, l_partkey as d from lineitem)) group by l_suppkey, i")
def gaps_islands(spark, sf):  # WIN-10, SNK-09
    return windows.encode_ranges(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey")


@query("ranges_decoded", "select distinct l_suppkey, l_partkey from lineitem")
def ranges_decoded(spark, sf):  # SNK-09, the way back
    return windows.decode_ranges(windows.encode_ranges(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")


@query("second_round_split", "select user_id, event_id, coalesce(bool_or(event_type = 'signup') over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), false) as second from events")
def second_round_split(spark, sf):  # WIN-09
    return windows.after_marker(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", F.col("event_type") == "signup").select("user_id", "event_id", "second")


@query("vote_shares", f"with {RESULTS}, t as (select party, sum(votes) as votes from results group by party) select party, cast(votes as bigint) as votes, round(votes / sum(votes) over (), 9) as share from t")
def vote_shares(spark, sf):  # WIN-12
    totals = elections.party_totals(results(spark, sf)).select("party", "votes")
    return windows.share_of_total(totals, "votes").withColumn("share", F.round("share", 9))


@query("top_k_points", "select p_partkey, p_brand, cast(row_number() over (order by k desc, p_partkey desc) as integer) as rank from (select *, regexp_replace(p_brand, '[0-9]+', '') || lpad(regexp_extract(p_brand, '[0-9]+'), 12, '0') as k from part) qualify rank <= 50")
def top_k_points(spark, sf):  # SRT-01, SRT-02, SRT-08: numeric collation, descending ties
    key = windows.numeric_key(F.col("p_brand"))
    return windows.top_k(table(spark, sf, "part").select("p_partkey", "p_brand"), windows.ordered([(key, False), (F.col("p_partkey"), False)], descending=True), 50)


@query("desc_negates_ties", f"with {POINTS} select id, cast(row_number() over (order by kind desc, date desc, body desc, id desc) as bigint) as place from points")
def desc_negates_ties(spark, sf):  # SRT-02, SRT-10
    order = windows.ordered([(F.col(c), False) for c in ("kind", "date", "body", "id")], descending=True)
    return sinks.with_parts(points(spark, sf).select("id", "kind", "date", "body"), order).select("id", F.col("ordinal").cast("bigint").alias("place"))


@query("page_slice", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 250 offset 500")
def page_slice(spark, sf):  # SRT-04, SRT-09
    return windows.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 2, 250)


@query("cumulative_pages", "select o_orderkey from orders order by o_orderdate, o_orderkey limit 300")
def cumulative_pages(spark, sf):  # SRT-09
    return windows.page(table(spark, sf, "orders"), [F.asc("o_orderdate"), F.asc("o_orderkey")], 2, 100, cumulative=True).select("o_orderkey")


@query("fixed_orders", f"with {BALLOTS} select vote, count(*) as n, cast(case vote when 'Ja' then 1 when 'Nej' then 2 when 'Avstår' then 3 when 'Frånvarande' then 4 else 5 end as integer) as place from ballots group by vote")
def fixed_orders(spark, sf):  # SRT-11
    return ballots(spark, sf).groupBy("vote").agg(F.count("*").alias("n")).withColumn("place", windows.fixed_order(F.col("vote"), list(votes.VOTES)))


@query("part_assignment", "select p_partkey, row_number() over (order by p_brand, p_partkey) as ordinal, cast(ceil(row_number() over (order by p_brand, p_partkey) / 128.0) as integer) as part from part")
def part_assignment(spark, sf):  # SNK-02
    return sinks.with_parts(table(spark, sf, "part").select("p_partkey", "p_brand"), ["p_brand", "p_partkey"]).select("p_partkey", "ordinal", "part")


@query("export_projection", "select o_orderkey as \"Nr\", o_orderpriority as \"Typ\", strftime(o_orderdate, '%d/%m/%Y') as \"Datum\", printf('%.2f%%', 12.5 * (o_custkey % 8)) as \"Andel\" from orders")
def export_projection(spark, sf):  # SNK-06, PRJ-21, PRJ-23
    from rostra.functions.keys import display_date, percent_text

    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("Nr"), F.col("o_orderpriority").alias("Typ"), display_date(F.col("o_orderdate")).alias("Datum"), percent_text(F.col("o_custkey") % 8, F.lit(8)).alias("Andel"))


@query("export_documents", "select doc_id::varchar as \"Id\", upper(lang) as \"Språk\", case when length(text) > 80 then rtrim(text[1:80]) || '…' else text end as \"Utdrag\", coalesce(toxic, 0) = 1 as \"Granskas\" from documents left join labels using (doc_id)")
def export_documents(spark, sf):  # SNK-06
    from rostra.functions.keys import preview

    both = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return both.select(F.col("doc_id").cast("string").alias("Id"), F.upper("lang").alias("Språk"), preview(F.col("text"), 80).alias("Utdrag"), (F.coalesce("toxic", F.lit(0)) == 1).alias("Granskas"))


@query("export_decisions", f"with {POINTS}, {BALLOTS}, v as (select id, count(*) filter (vote = 'Ja') as ja, count(*) filter (vote = 'Nej') as nej from ballots group by 1) select strftime(date, '%d/%m/%Y') as \"Datum\", body as \"Organ\", '§ ' || id::varchar as \"Paragraf\", case result when 'F' then 'Bifall' when 'O' then 'Avslag' else result end as \"Resultat\", coalesce(ja, 0) as \"Ja\", coalesce(nej, 0) as \"Nej\" from points left join v using (id)")
def export_decisions(spark, sf):  # SNK-06
    from rostra.functions.keys import display_date, mapped

    count = lambda word: F.count_if(F.col("vote") == word)
    tally = ballots(spark, sf).groupBy("id").agg(count("Ja").alias("ja"), count("Nej").alias("nej"))
    p = points(spark, sf).join(tally, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return p.select(display_date(F.col("date")).alias("Datum"), F.col("body").alias("Organ"), F.concat(F.lit("§ "), F.col("id").cast("string")).alias("Paragraf"), mapped(F.col("result"), {"F": "Bifall", "O": "Avslag"}).alias("Resultat"), zero("ja").alias("Ja"), zero("nej").alias("Nej"))


@query("export_elections", "with r as (select n_name as region, c_mktsegment as party, count(*) as votes from customer join nation on c_nationkey = n_nationkey group by 1, 2), s as (select *, sum(votes) over (partition by region)::bigint as n, (votes * 20000 + n) // (2 * n) as h from r) select region as \"Område\", party as \"Parti\", votes as \"Röster\", printf('%d.%02d%%', h // 100, h % 100) as \"Andel\" from s")
def export_elections(spark, sf):  # SNK-06
    from pyspark.sql import Window as W

    from rostra.functions.keys import percent_text

    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    votes = c.groupBy(F.col("n_name").alias("region"), F.col("c_mktsegment").alias("party")).agg(F.count("*").alias("votes"))
    return votes.select(F.col("region").alias("Område"), F.col("party").alias("Parti"), F.col("votes").alias("Röster"), percent_text(F.col("votes"), F.sum("votes").over(W.partitionBy("region"))).alias("Andel"))
