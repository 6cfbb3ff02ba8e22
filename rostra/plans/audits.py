"""Data quality, incremental ingestion, sinks and streams (DQ, STR, SNK, AGG-18)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rostra.operators import quality
from rostra.plans.civic import query, table
from rostra.sources import sinks
from rostra.streaming import arrivals


def rules(spark, sf):
    docs, labels, orders, items = (table(spark, sf, t) for t in ("documents", "labels", "orders", "lineitem"))
    short = lambda: docs.where("n_chars < 60").select(F.col("doc_id").alias("key"))
    return [
        quality.Rule("missing_field", "error", lambda: quality.missing(docs.withColumn("source", F.when(F.col("doc_id") % 97 == 0, "").otherwise(F.col("source"))), "doc_id", ["text", "lang", "source"])),
        quality.Rule("repeated_ballot", "error", lambda: quality.repeated(items, ["l_orderkey", "l_linenumber"])),
        quality.Rule("unlabelled", "review", lambda: quality.dangling(docs, labels, ["doc_id"], "doc_id")),
        quality.Rule("ballot_without_point", "error", lambda: quality.dangling(items.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), orders, ["o_orderkey"], "o_orderkey")),
        quality.Rule("short_text", "info", short),
    ]


ISSUES = """i as (select 'missing_field' as category, 'error' as severity, doc_id::varchar as key from documents where doc_id % 97 = 0 or text = '' or lang is null or source is null or text is null
 union all select 'repeated_ballot', 'error', l_orderkey::varchar || '|' || l_linenumber::varchar from lineitem group by l_orderkey, l_linenumber having count(*) > 1
 union all select 'unlabelled', 'review', doc_id::varchar from documents where doc_id not in (select doc_id from labels)
 union all select 'ballot_without_point', 'error', l_orderkey::varchar from lineitem where l_orderkey not in (select o_orderkey from orders)
 union all select 'short_text', 'info', doc_id::varchar from documents where n_chars < 60)"""


@query("dq_issues", f"""with {ISSUES}, k as (select category, key, row_number() over (partition by category order by key) as r from (select distinct category, key from i))
 select category, severity, count(*) as n, any_value(s) as samples from i join (select category, string_agg(key, ',' order by key) as s from k where r <= 8 group by 1) using (category) group by category, severity""")
def dq_issues(spark, sf):  # DQ-01 to 05, DQ-07, AGG-18
    return quality.counted(quality.issues(rules(spark, sf)))


@query("dq_gate", f"with {ISSUES} select count(*) filter (severity in ('error', 'review')) as blocking, count(*) filter (severity in ('error', 'review')) = 0 as passes from i")
def dq_gate(spark, sf):  # DQ-08, PRS-12
    return quality.gate(quality.issues(rules(spark, sf)))


@query("derived_parity", "select doc_id, f as field from documents join labels using (doc_id), (values ('quality'), ('toxic')) v(f) where case f when 'quality' then quality <> (n_chars > 200)::int else toxic is distinct from (case when doc_id % 2 = 0 then 0 end) end")
def derived_parity(spark, sf):  # DQ-06
    labels = table(spark, sf, "labels")
    derived = table(spark, sf, "documents").join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", (F.col("n_chars") > 200).cast("int").alias("quality"), F.when(F.col("doc_id") % 2 == 0, 0).alias("toxic"))
    return quality.parity(derived, labels, "doc_id", ["quality", "toxic"])


@query("repair_pipeline", "select o_orderkey, case when o_orderkey % 10 = 0 then 'fixed' else lower(o_orderpriority) end as kind, case when row_number() over (partition by o_custkey order by o_orderkey) = 1 then o_custkey::varchar else o_custkey::varchar || '__source_' || o_orderkey::varchar end as unique_id from orders where o_orderstatus <> 'P'")
def repair_pipeline(spark, sf):  # DQ-10: corrections, cleaning, pruning, disambiguation, in that order
    from rostra.operators import joins, windows

    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderpriority").alias("kind"))
    fixes = o.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("Fixed ").alias("kind"))
    steps = [
        lambda df: joins.corrected(df, fixes, "o_orderkey", ["kind"]),
        lambda df: df.withColumn("kind", F.trim(F.lower("kind"))),
        lambda df: joins.prune(df, df.where("o_orderstatus <> 'P'"), ["o_orderkey"]),
        lambda df: windows.disambiguated(df, "o_custkey", "o_orderkey"),
    ]
    for step in steps:
        o = o.transform(step)
    return o.select("o_orderkey", "kind", "unique_id")


@query("incremental_work", "select doc_id, source from documents where doc_id not in (select doc_id from labels where quality = 1)")
def incremental_work(spark, sf):  # STR-06
    state = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "done").otherwise("needs_review").alias("status"))
    return arrivals.new_work(table(spark, sf, "documents").select("doc_id", "source"), state, "doc_id")


@query("merged_pack", "select distinct * from (select l_orderkey as doc_index, l_suppkey as name from lineitem union all select l_orderkey + 1 + (select max(o_orderkey) from orders), l_suppkey from lineitem)")
def merged_pack(spark, sf):  # STR-07, SRC-02
    docs, rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_index")), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_index"), F.col("l_suppkey").alias("name"))
    return arrivals.merged_pack(docs, docs, rows, rows, same=["doc_index", "name"])[1]


@query("diary_upsert", "select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(b.diary, a.diary) as diary from (select doc_id, 'old' as diary from labels where doc_id % 2 = 0) a full join (select doc_id, 'new' as diary from labels where doc_id % 3 = 0) b using (doc_id)")
def diary_upsert(spark, sf):  # SNK-05
    labels = table(spark, sf, "labels")
    return sinks.upserted(labels.where("doc_id % 2 = 0").select("doc_id", F.lit("old").alias("diary")), labels.where("doc_id % 3 = 0").select("doc_id", F.lit("new").alias("diary")), "doc_id", ["diary"])


@query("byte_bounded_parts", """with recursive d as (select source, doc_id, strlen(text)::bigint as z, row_number() over (partition by source order by doc_id) as i, sum(strlen(text)) over (partition by source order by doc_id)::bigint as upto from documents),
 p as (select source, 1 as part, 0::bigint as s, greatest(1, coalesce(max(i) filter (upto <= 60000), 1)) as e, max(i) as n from d group by source
  union all select p.source, p.part + 1, p.e, greatest(p.e + 1, coalesce((select max(d.i) from d where d.source = p.source and d.i > p.e and d.upto - (select x.upto from d x where x.source = p.source and x.i = p.e) <= 60000), p.e + 1)), p.n from p where p.e < p.n)
 select source, doc_id, part from d join p using (source) where i > s and i <= e""")
def byte_bounded_parts(spark, sf):  # SNK-03
    docs = table(spark, sf, "documents").select("source", "doc_id", F.octet_length("text").alias("size"))
    return sinks.byte_bounded_parts(docs, "source", "doc_id", "size", 60_000)


@query("sparse_rows", "select p_partkey, nullif(case when p_partkey % 2 = 0 then '' else p_brand end, '') is null as dropped from part")
def sparse_rows(spark, sf):  # SNK-01
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_brand")).alias("b"))
    return sinks.sparse(p).select("p_partkey", F.col("b").isNull().alias("dropped"))


@query("stream_summary", "select event_type, count(*) as n, sum(user_id)::bigint as users from events group by event_type")
def stream_summary(spark, sf):  # STR-01, STR-02: the final state of a stream over files equals the batch
    source, summary = sinks.scratch_path(spark), arrivals.RunningSummary(sinks.scratch_path(spark), ["event_type"], {"users": "user_id"}, compact=2)
    table(spark, sf, "events").select("event_id", "user_id", "event_type").repartition(4).write.parquet(source)
    return stream_into(spark, source, summary, sinks.scratch_path(spark)).result(spark, EVENTS)


EVENTS = StructType([StructField("event_id", LongType()), StructField("user_id", LongType()), StructField("event_type", StringType())])


def stream_into(spark, source, summary, checkpoint):
    """Whatever has come below ``source`` since the checkpoint goes into the summary, file by file."""
    arrivals.arriving(spark, source, EVENTS).writeStream.foreachBatch(summary).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return summary


@query("stream_topk_equals_batch", "select event_id, round(value, 4) as value from events order by round(value, 4) desc, event_id limit 25")
def stream_topk_equals_batch(spark, sf):  # STR-02, STR-08
    source = sinks.scratch_path(spark)
    rows = table(spark, sf, "events").select("event_id", F.round("value", 4).alias("value"))
    rows.repartition(4).write.parquet(source)
    best = arrivals.RunningTopK(sinks.scratch_path(spark), [F.desc("value"), F.asc("event_id")], "event_id", 25)
    q = arrivals.arriving(spark, source, "event_id bigint, value double").writeStream.foreachBatch(best).option("checkpointLocation", sinks.scratch_path(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return best.result(spark, rows.schema)


@query("document_issues", """with d as (select o_orderkey // 2 * 2 + case when o_orderkey % 40 = 1 then 0 else o_orderkey % 2 end as id, case when o_orderkey % 19 = 0 then '2024-13-01' when o_orderkey % 23 = 0 then '24-1-1' else '2024-03-0' || (1 + o_orderkey % 4)::varchar end as date, o_orderkey as k from orders)
 select 'repeated_id' as category, 'error' as severity, id::varchar as key from d group by id having count(*) > 1
 union all select 'bad_date', 'error', id::varchar from d where k % 19 = 0 or k % 23 = 0
 union all select 'title_date_differs', 'review', id::varchar from d where k % 3 = 0 and date <> '2024-03-01'
 union all select 'unknown_host', 'error', id::varchar from d where k % 29 = 0 or k % 31 = 0
 union all select 'boilerplate_left', 'review', id::varchar from d where k % 37 = 0""")
def document_issues(spark, sf):  # DQ-01, DQ-02
    k = F.col("o_orderkey")
    docs = table(spark, sf, "orders").select(
        (F.floor(k / 2) * 2 + F.when(k % 40 == 1, 0).otherwise(k % 2)).alias("id"), F.when(k % 19 == 0, "2024-13-01").when(k % 23 == 0, "24-1-1").otherwise(F.concat(F.lit("2024-03-0"), (1 + k % 4).cast("string"))).alias("date"),
        F.when(k % 3 == 0, "Protokoll 2024-03-01").otherwise("Protokoll").alias("title"), F.when(k % 29 == 0, "https://other.org/a").when(k % 31 == 0, "a.pdf").otherwise("HTTPS://Example.org/a?b").alias("url"),
        F.when(k % 37 == 0, "text\nDigitalt justerat protokoll").otherwise("text").alias("text"),
    )
    return quality.issues(quality.document_rules(docs, ["example.org"], "(?i)digitalt justerat"))


@query("ballot_issues", """with b as (select case when l_orderkey % 53 = 0 then -l_orderkey else l_orderkey end as id, l_suppkey as name, case when l_orderkey % 50 = 0 and l_linenumber = 1 then 'Kanske' else 'Ja' end as vote, case when l_orderkey % 97 = 0 then '' else l_orderkey::varchar end as event from lineitem),
 s as (select o_orderkey::varchar as event, o_custkey % 6 as n from orders)
 select 'ballot_without_point' as category, 'error' as severity, id::varchar as key from b where id < 0 union all select 'unknown_vote', 'error', id::varchar from b where vote = 'Kanske' union all select 'event_missing', 'error', id::varchar from b where event = ''
 union all select 'named_over_stated', 'review', event from (select event, count(*) as c from b where event <> '' group by 1) join s using (event) where c > n""")
def ballot_issues(spark, sf):  # DQ-03, DQ-04
    k, orders = F.col("l_orderkey"), table(spark, sf, "orders")
    ballots = table(spark, sf, "lineitem").select(F.when(k % 53 == 0, -k).otherwise(k).alias("id"), F.col("l_suppkey").alias("name"), F.when((k % 50 == 0) & (F.col("l_linenumber") == 1), "Kanske").otherwise("Ja").alias("vote"), F.when(k % 97 == 0, "").otherwise(k.cast("string")).alias("event"))
    stated = orders.select(F.col("o_orderkey").cast("string").alias("event"), (F.col("o_custkey") % 6).alias("n"))
    return quality.issues(quality.ballot_rules(ballots, orders.select(F.col("o_orderkey").alias("id")), stated, ["Ja", "Nej", "Avstår", "Frånvarande"]))


@query("ballot_issues_by_vote", """with b as (select case when l_orderkey % 53 = 0 then -l_orderkey else l_orderkey end as id, l_suppkey as name, case when l_orderkey % 50 = 0 and l_linenumber = 1 then 'Kanske' when l_returnflag = 'A' then 'Ja' when l_returnflag = 'N' then 'Nej' else 'Frånvarande' end as vote, case when l_orderkey % 97 = 0 then '' else l_orderkey::varchar end as event from lineitem),
 s as (select o_orderkey::varchar as event, v as vote, o_custkey % 3 as n from orders, (values ('Ja'), ('Nej')) t(v) where o_custkey % 10 > 0)
 select 'ballot_without_point' as category, 'error' as severity, id::varchar as key from b where id < 0 union all select 'unknown_vote', 'error', id::varchar from b where vote = 'Kanske' union all select 'event_missing', 'error', id::varchar from b where event = ''
 union all select 'named_over_stated', 'review', event || '|' || vote from (select event, vote, count(*) as c from b where event <> '' group by 1, 2) join s using (event, vote) where c > n""")
def ballot_issues_by_vote(spark, sf):  # DQ-04: each vote by itself; events whose conflict is known state nothing
    k, orders = F.col("l_orderkey"), table(spark, sf, "orders")
    vote = F.when((k % 50 == 0) & (F.col("l_linenumber") == 1), "Kanske").when(F.col("l_returnflag") == "A", "Ja").when(F.col("l_returnflag") == "N", "Nej").otherwise("Frånvarande")
    ballots = table(spark, sf, "lineitem").select(F.when(k % 53 == 0, -k).otherwise(k).alias("id"), F.col("l_suppkey").alias("name"), vote.alias("vote"), F.when(k % 97 == 0, "").otherwise(k.cast("string")).alias("event"))
    stated = orders.where("o_custkey % 10 > 0").select(F.col("o_orderkey").cast("string").alias("event"), F.explode(F.array(F.lit("Ja"), F.lit("Nej"))).alias("vote"), (F.col("o_custkey") % 3).alias("n"))
    return quality.issues(quality.ballot_rules(ballots, orders.select(F.col("o_orderkey").alias("id")), stated, ["Ja", "Nej", "Avstår", "Frånvarande"]))


@query("attendance_issues", """with a as (select l_orderkey as meeting, l_suppkey as name from lineitem where l_linenumber % 3 > 0), v as (select distinct l_orderkey as meeting, l_suppkey as name from lineitem where l_orderkey % 9 = 0)
 select 'unknown_meeting' as category, 'error' as severity, meeting::varchar as key from a where meeting not in (select o_orderkey from orders where o_orderkey % 45 > 0)
 union all select 'voter_missing', 'review', meeting::varchar || '|' || name::varchar from (select * from v except select * from a)""")
def attendance_issues(spark, sf):  # DQ-05
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("meeting"), F.col("l_suppkey").alias("name"), "l_linenumber")
    meetings = table(spark, sf, "orders").where("o_orderkey % 45 > 0").select(F.col("o_orderkey").alias("meeting"))
    return quality.issues(quality.attendance_rules(rows.where("l_linenumber % 3 > 0").drop("l_linenumber"), meetings, rows.where("meeting % 9 = 0").select("meeting", "name")))


@query("diary_pack", """with o as (select doc_id, 'u' || doc_id::varchar as url, 't' || (doc_id // 2)::varchar as title, case when doc_id % 5 = 0 then 'old' end as diary from documents where doc_id % 3 > 0),
 n as (select case when doc_id % 4 = 0 then 'v' else 'u' end || doc_id::varchar as url, 't' || (doc_id // 2)::varchar as title, 'Ks ' || (doc_id % 7)::varchar || '/2024' as d from documents where doc_id % 2 = 0 and doc_id % 11 > 0),
 r as (select * from n where url not in (select url from o)), t as (select title, min(d) as d from r group by 1)
 select o.url, o.title, coalesce((select min(d) from n where n.url = o.url), t.d, diary) as diary from o left join t using (title)
 union all select url, (min(row(d, title))).title, min(d) from (select url, d, title from r where title not in (select title from o)) group by url""".replace("(min(row(d, title))).title", "arg_min(title, row(d, title))"))
def diary_pack(spark, sf):  # SNK-05
    k, docs = F.col("doc_id"), table(spark, sf, "documents")
    title = F.concat(F.lit("t"), F.floor(k / 2).cast("string")).alias("title")
    old = docs.where("doc_id % 3 > 0").select(F.concat(F.lit("u"), k.cast("string")).alias("url"), title, F.when(k % 5 == 0, "old").alias("diary"))
    new = docs.where("doc_id % 2 = 0").select(F.concat(F.when(k % 4 == 0, "v").otherwise("u"), k.cast("string")).alias("url"), title, F.when(k % 11 > 0, F.concat(F.lit("Ks "), (k % 7).cast("string"), F.lit("/2024"))).otherwise(" ").alias("diary"))
    return sinks.merged_diaries(old, new)[0]


@query("bootstrap_rows", "select o_orderkey, o_orderpriority, o_orderstatus, (select count(*) from orders) as total, (select count(distinct o_orderpriority) from orders) as n_o_orderpriority, (select count(distinct o_orderstatus) from orders) as n_o_orderstatus from orders order by o_orderdate desc, o_orderkey limit 8")
def bootstrap_rows(spark, sf):  # SNK-04
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    return sinks.bootstrap(o, [F.desc("o_orderdate"), F.asc("o_orderkey")], ["o_orderpriority", "o_orderstatus"]).drop("o_orderdate")


@query("stream_retarget", "select user_id, count(*) as n, sum(event_id)::bigint as ids from events where event_type = 'click' group by user_id")
def stream_retarget(spark, sf):  # STR-03: the filter changes while rows arrive; the new one catches up from the partial tables
    source, checkpoint = sinks.scratch_path(spark), sinks.scratch_path(spark)
    summary = arrivals.RunningSummary(sinks.scratch_path(spark), ["event_type", "user_id"], {"ids": "event_id"}, compact=3)
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    rows.where("event_id % 2 = 0").repartition(2).write.parquet(source)
    stream_into(spark, source, summary, checkpoint).result(spark, EVENTS, ["user_id"], F.col("event_type") == "view").head()
    rows.where("event_id % 2 = 1 or event_id is null").repartition(2).write.mode("append").parquet(source)
    return stream_into(spark, source, summary, checkpoint).result(spark, EVENTS, ["user_id"], F.col("event_type") == "click")


@query("ingestion_ledger", """with k as (select doc_id as k from documents where doc_id % 11 > 0)
 select k::varchar as key, case when k % 5 = 0 and k % 7 > 0 and k % 2 = 1 then 'needs_review' when k % 5 = 0 and k % 7 = 0 then 'needs_review' else 'done' end as status,
  cast(case when k % 7 = 0 then case when k % 5 = 0 then 2 else 1 end when k % 5 = 0 then case when k % 2 = 0 then 2 else 3 end else 1 end as integer) as tries from k
 union all select doc_id::varchar, 'done', 1 from documents where doc_id % 11 = 0""")
def ingestion_ledger(spark, sf):  # STR-06: three runs; what fails is new again, what needs review is tried again
    ledger = arrivals.IngestionLedger(spark, sinks.scratch_path(spark))
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("key"), "doc_id")
    k = F.col("doc_id")

    def work(run):
        failed, unclear = (k % 7 == 0) & F.lit(run == 1), (k % 5 == 0) & ~((k % 2 == 0) & (k % 7 > 0) & F.lit(run > 1))
        return lambda due: due.select("key", F.when(failed & (k % 11 > 0), F.lit(None)).when(unclear & (k % 11 > 0), "needs_review").otherwise("done").alias("status"))

    for run in (1, 2, 3):
        ledger.run(docs, work(run))
    return ledger.state()
