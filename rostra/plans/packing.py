"""Packs written and read again, link and archive audits (SRC-01, 02, 05, 06, SNK-07, DQ-07, DQ-09)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostra.operators import quality
from rostra.plans import search
from rostra.plans.civic import ORACLE_SQL, query, table
from rostra.sources import packs, sinks

#: Bytes of a part of a pack, about.
PART_BYTES = 1 << 20


@query("pack_votes", "select l_orderkey::varchar as doc_index, l_linenumber::varchar as point, 'Ä \"' || l_suppkey::varchar || '\"' as name, l_returnflag as party, l_linestatus as vote, l_orderkey::varchar || ':' || l_linenumber::varchar as participant_id from lineitem")
def pack_votes(spark, sf):  # SRC-01, SRC-02: parts of a pack written as scripts, and read as one
    li, path = table(spark, sf, "lineitem"), sinks.scratch_path(spark)
    text = lambda c: F.col(c).cast("string")
    six = F.array(text("l_orderkey"), text("l_linenumber"), F.concat(F.lit('Ä "'), text("l_suppkey"), F.lit('"')), F.col("l_returnflag"), F.col("l_linestatus"), F.concat_ws(":", text("l_orderkey"), text("l_linenumber")))
    held = li.agg(F.sum(F.octet_length(F.to_json(six)))).head()[0] or 0
    parts = li.groupBy(F.pmod(F.xxhash64("l_orderkey"), F.lit(-(-held // PART_BYTES) or 1)).alias("part")).agg(F.flatten(F.collect_list(six)).alias("r"))
    said = F.concat(F.lit("window.pack = "), F.to_json(F.struct(F.lit("v1").alias("schema"), "r")), F.lit(";"))
    parts.select("part", said.alias("value")).repartition("part").write.partitionBy("part").text(path)
    return packs.read_pack(spark, [f"{path}/part=*"])["votes"].select(*packs.VOTE_FIELDS)


@query("gz_texts", "select doc_id, md5(text) as digest, doc_id % 3 > 0 as coded from documents")
def gz_texts(spark, sf):  # SRC-05
    packs.small_batches(spark)
    docs, coded = table(spark, sf, "documents"), F.col("doc_id") % 3 > 0
    held = docs.select("doc_id", F.when(coded, packs.gzipped("text")).otherwise(F.col("text")).alias("t"))
    return held.select("doc_id", F.md5(packs.gunzipped("t").cast("binary")).alias("digest"), F.startswith("t", F.lit("gz:")).alias("coded"))


@query("ndjson_rows", "select o_orderkey as id, nullif(o_orderpriority, '1-URGENT') as kind, (select count(*) from orders) as total from orders")
def ndjson_rows(spark, sf):  # SRC-06, SNK-01: a compressed file of lines with a leading row about them
    o, path = table(spark, sf, "orders"), sinks.scratch_path(spark)
    meta = o.agg(F.count("*").alias("total")).select(F.lit("meta").alias("type"), "total", F.lit(1).cast("bigint").alias("meetings"))
    sinks.write_ndjson(meta, f"{path}/a")
    sinks.write_ndjson(o.select(F.col("o_orderkey").alias("id"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("kind")), f"{path}/b")
    about, rows = packs.ndjson(spark, f"{path}/*", "struct<id:bigint,kind:string>")
    return rows.join(F.broadcast(about.select("total")))  # one row


@query("published_table", "select o_orderkey, o_orderpriority as kind from orders where o_orderstatus <> 'P'")
def published_table(spark, sf):  # SNK-07: a table that fails its check leaves the published one as it is
    path, rows = f"{sinks.scratch_path(spark)}/gold", table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("kind"), "o_orderstatus")
    sinks.publish(spark, rows.where("o_orderstatus = 'F'").drop("o_orderstatus"), path, lambda df: True)
    sinks.publish(spark, rows.where("o_orderstatus <> 'P'").drop("o_orderstatus"), path, lambda df: not df.where("kind is null").head(1))
    sinks.publish(spark, rows.withColumn("kind", F.lit(None).cast("string")).drop("o_orderstatus"), path, lambda df: not df.where("kind is null").head(1))
    return spark.read.parquet(path)


@query("link_audit", f"""select kind, pool, count(*) as links, count(*) filter (target = ref // 3 or (target is not null and not exists (select 1 from orders where o_orderkey = target)) or (pool in ('document', 'meeting', 'body', 'all', 'matter')) = (target is null)) as bad
 from ({ORACLE_SQL['ref_target_tiers']}) l group by 1, 2""")
def link_audit(spark, sf):  # DQ-07: links to the own row, to no row, or of none in a pool of rows are bad
    links = search.ref_target_tiers(spark, sf).withColumn("own", F.floor(F.col("ref") / 3))
    known = table(spark, sf, "orders").select(F.col("o_orderkey").alias("target"), F.lit(1).alias("known"))
    both = links.join(known, "target", "left")
    named = F.col("pool").isin("document", "meeting", "body", "all", "matter")
    bad = (F.col("target") == F.col("own")) | (F.col("target").isNotNull() & F.col("known").isNull()) | (named & F.col("target").isNull()) | (~named & F.col("target").isNotNull())
    return both.groupBy("kind", "pool").agg(F.count("*").alias("links"), F.count_if(bad).alias("bad"))


@query("link_faults", f"""with l as (select ref, kind, pool, case when ref % 13 = 0 then ref // 3 when ref % 17 = 0 then -5 when ref % 19 = 0 then null when ref % 23 = 0 then coalesce(target, 1) else target end as target from ({ORACLE_SQL['ref_target_tiers']}))
 select ref, case when target = ref // 3 then 'own_row' when target is not null and not exists (select 1 from orders where o_orderkey = target) then 'no_such_row' when target is null then 'target_missing' else 'target_in_no_pool' end as fault
 from l where target = ref // 3 or (target is not null and not exists (select 1 from orders where o_orderkey = target)) or (pool in ('document', 'meeting', 'body', 'all', 'matter')) = (target is null)""")
def link_faults(spark, sf):  # DQ-07: which links are bad, and why, when some are spoilt
    ref = F.col("ref")
    own = F.floor(ref / 3)
    target = F.when(ref % 13 == 0, own).when(ref % 17 == 0, -5).when(ref % 19 == 0, F.lit(None)).when(ref % 23 == 0, F.coalesce("target", F.lit(1))).otherwise(F.col("target"))
    links = search.ref_target_tiers(spark, sf).select("ref", "pool", target.alias("target"), own.alias("own"))
    known = table(spark, sf, "orders").select(F.col("o_orderkey").alias("target"), F.lit(1).alias("known"))
    named = F.col("pool").isin("document", "meeting", "body", "all", "matter")
    fault = (
        F.when(F.col("target") == F.col("own"), "own_row").when(F.col("target").isNotNull() & F.col("known").isNull(), "no_such_row").when(named & F.col("target").isNull(), "target_missing")
        .when(~named & F.col("target").isNotNull(), "target_in_no_pool")
    )
    return links.join(known, "target", "left").select("ref", fault.alias("fault")).where("fault is not null")


@query("archive_issues", """with f as (select doc_id, case when doc_id % 50 = 0 then '../' || source when doc_id % 41 = 0 then '' else '2024/' || source || '/' || doc_id::varchar || '.pdf' end as path, source as body, (date '2024-01-01' + (doc_id % 300)::int)::varchar as date from documents)
 select 'path_outside' as category, 'error' as severity, doc_id::varchar as key from f where path like '../%' union all select 'path_missing', 'error', doc_id::varchar from f where path = ''
 union all select 'repeated_meeting', 'error', body || '|' || date from f group by body, date having count(*) > 1""")
def archive_issues(spark, sf):  # DQ-09
    k = F.col("doc_id")
    path = F.when(k % 50 == 0, F.concat(F.lit("../"), "source")).when(k % 41 == 0, "").otherwise(F.concat(F.lit("2024/"), "source", F.lit("/"), k.cast("string"), F.lit(".pdf")))
    files = table(spark, sf, "documents").select("doc_id", path.alias("path"), F.col("source").alias("body"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")).cast("string").alias("date"))
    return quality.issues(quality.archive_rules(files, "doc_id", "path", ["body", "date"]))


@query("pack_parts_with_children", """with recursive docs as (select c_custkey as doc, c_nationkey as date, 'B' || (c_custkey % 3)::varchar as body, c_name as name from customer),
 votes as (select o_custkey as doc, l_linenumber as n, l_returnflag as vote from lineitem join orders on l_orderkey = o_orderkey), positions as (select o_custkey as doc, o_orderpriority as stance from orders),
 att as (select s_nationkey as date, case when s_suppkey % 7 = 0 then 'none' else 'B' || (s_suppkey % 3)::varchar end as body, s_name as name from supplier),
 own as (select date, body, min(doc) as doc from docs group by 1, 2),
 z as (select doc, strlen('{"doc":' || doc::varchar || ',"date":' || date::varchar || ',"body":"' || body || '","name":"' || name || '"}') + 1 as z from docs
  union all select doc, strlen('{"doc":' || doc::varchar || ',"n":' || n::varchar || ',"vote":"' || vote || '"}') + 1 from votes union all select doc, strlen('{"doc":' || doc::varchar || ',"stance":"' || stance || '"}') + 1 from positions
  union all select coalesce(doc, (select min(doc) from docs)), strlen('{"date":' || date::varchar || ',"body":"' || body || '","name":"' || name || '"}') + 1 from att left join own using (date, body) union all select min(doc), 500 from docs),
 w as (select doc, sum(z)::bigint as bytes from z where doc in (select doc from docs) group by doc), c as (select doc, bytes, row_number() over (order by doc) as i, sum(bytes) over (order by doc) as upto from w),
 parts as (select 1 as part, 0::bigint as s, (select max(i) from c where upto <= 20000) as e union all select part + 1, e, (select max(i) from c where i > e and upto - (select x.upto from c x where x.i = e) <= 20000) from parts where e < (select max(i) from c))
 select doc, bytes, part from c join parts on i > s and i <= e""")
def pack_parts_with_children(spark, sf):  # SNK-03: votes, positions and first-owned attendance follow their documents
    docs = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc"), F.col("c_nationkey").alias("date"), F.concat(F.lit("B"), (F.col("c_custkey") % 3).cast("string")).alias("body"), F.col("c_name").alias("name"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("doc"), "o_orderpriority")
    votes = table(spark, sf, "lineitem").join(orders, "l_orderkey").select("doc", F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("vote"))
    body = F.when(F.col("s_suppkey") % 7 == 0, "none").otherwise(F.concat(F.lit("B"), (F.col("s_suppkey") % 3).cast("string")))
    there = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("date"), body.alias("body"), F.col("s_name").alias("name"))
    weights = sinks.pack_weights(docs, "doc", ["date", "body"], [votes, orders.select("doc", F.col("o_orderpriority").alias("stance"))], there, header=500)
    return sinks.pack_parts(weights, "doc", 20_000, refuse=False)  # as its SQL: parts end before a document that fits into none
