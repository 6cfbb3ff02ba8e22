"""Scalar projections (PRJ, PRS-06, 07, 11, 13, 19, 22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostra.functions import keys, text
from rostra.operators import votes
from rostra.plans.civic import query, table


@query("normalize_text", "select doc_id, trim(regexp_replace(strip_accents(lower(replace(text, 'ß', '@'))), '[^a-z0-9]+', ' ', 'g')) as normal from documents")
def normalize_text(spark, sf):  # TXT-01
    return table(spark, sf, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normal"))


@query("normalize_decision", "select doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(replace(text, 'ß', '@'))), '[§.,:;!?()\\[\\]{}\"“”‘’–—/\\\\''-]+', ' ', 'g'), '\\s+', ' ', 'g')) as normal from documents")
def normalize_decision(spark, sf):  # TXT-02
    return table(spark, sf, "documents").select("doc_id", text.normalize_decision(F.regexp_replace("text", "ß", "@")).alias("normal"))


@query("canonical_names", """select c_custkey, trim(regexp_replace(lower('Hållbarhetssutskottet  ' || c_mktsegment || ' 2019-2022'), '\\s+', ' ', 'g')) as raw,
 'hållbarhetsutskottet ' || lower(c_mktsegment) as body, case when n_name = 'NATION_1' then 'ONE' else n_name end as region, case when c_custkey % 3 = 0 then 'Exempelpartiet' else c_mktsegment end as party from customer join nation on c_nationkey = n_nationkey""")
def canonical_names(spark, sf):  # PRJ-05, PRJ-06, PRJ-07
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    raw = F.concat(F.lit("Hållbarhetssutskottet  "), "c_mktsegment", F.lit(" 2019-2022"))
    party = F.when(F.col("c_custkey") % 3 == 0, "Ex. P.").otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", keys.squeezed(F.lower(raw)).alias("raw"), keys.body_name(F.regexp_replace(raw, "2019-2022", "2019 2022")).alias("body"), keys.region_name(F.concat(" n_name".strip(), F.lit(" Län")), {"NATION_1": "ONE"}).alias("region"), keys.party_name(party, {"Exempelpartiet": ["exp", "exempelpartiet"]}).alias("party"))


@query("label_dictionary", "select o_orderkey, case o_orderstatus when 'F' then 'Avgjord' when 'O' then 'Öppen' else o_orderstatus end as label from orders")
def label_dictionary(spark, sf):  # PRJ-08
    return table(spark, sf, "orders").select("o_orderkey", keys.mapped(F.col("o_orderstatus"), {"F": "Avgjord", "O": "Öppen"}).alias("label"))


CODES = ["approve", "avslag", "noted", "återremiss", "besvarad", "other", "refer_back", ""]


@query("result_group", """select o_orderkey, case o_custkey % 8 when 0 then 'approved' when 1 then 'rejected' when 2 then 'recorded' when 3 then 'continued' when 4 then 'answered' when 5 then 'other' when 6 then 'refer_back' else 'approved' end as grp from orders""")
def result_group(spark, sf):  # PRJ-09
    code = F.get(F.array(*[F.lit(c) for c in CODES]), (F.col("o_custkey") % 8).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", keys.result_group(code).alias("grp"))


RESULT_TEXTS = ("Motionen avslås.", "", "Fullmäktige beslutar: motionen  avslås.", "Motionen Avslås", "Nämnden", "promotionen avslås", "motionen avslåsning", "Nämnden avslår\tyrkandet om bidrag", "medborgarförslaget avslås")


@query("effective_result", """with t as (select o_orderkey, ['reject_counterproposal', 'avslag', 'approve', 'approve', ''][1 + o_custkey % 5] as r, [""" + ", ".join(f"'{x}'" for x in RESULT_TEXTS) + """][1 + o_orderkey % 9] as s from orders)
 select o_orderkey, case when r = 'reject_counterproposal' then r when r = 'avslag' or regexp_matches(s, '(^|[^\\p{L}])(ledamotsinitiativet|initiativet|motionen|medborgarförslaget|medborgarforslaget)\\s+avslås($|[^\\p{L}])')
   or regexp_matches(s, '(^|[^\\p{L}])avslår\\s+yrkandet\\s+om($|[^\\p{L}])') then 'reject' when r <> '' then r else 'other' end as effective from t""")
def effective_result(spark, sf):  # PRJ-10
    result = F.get(F.array(*[F.lit(x) for x in ("reject_counterproposal", "avslag", "approve", "approve", "")]), (F.col("o_custkey") % 5).cast("int"))
    said = F.get(F.array(*[F.lit(x) for x in RESULT_TEXTS]), (F.col("o_orderkey") % len(RESULT_TEXTS)).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", keys.effective_result(result, said, F.lit("")).alias("effective"))


@query("composite_keys", "select l_orderkey, l_linenumber, coalesce(nullif(l_returnflag, 'N'), '') || '|' || l_linenumber::varchar || '|' || l_orderkey::varchar as key, l_orderkey::varchar as base from lineitem")
def composite_keys(spark, sf):  # PRJ-03, PRJ-04
    li = table(spark, sf, "lineitem")
    event = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return li.select("l_orderkey", "l_linenumber", keys.composite_key(F.nullif(F.col("l_returnflag"), F.lit("N")), F.col("l_linenumber"), F.col("l_orderkey")).alias("key"), votes.event_base(event).alias("base"))


@query("first_valid_candidate", "select p_partkey, case when p_partkey % 3 = 0 then 'Ks ' || p_partkey::varchar || '/2024' when p_partkey % 3 = 1 then p_brand else '' end as diary from part")
def first_valid_candidate(spark, sf):  # PRJ-13
    a = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Ks "), F.col("p_partkey").cast("string"), F.lit("/2024"))).otherwise("Ks x/2024")
    b = F.when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise("ring")
    return table(spark, sf, "part").select("p_partkey", keys.first_valid(a, F.lit(None).cast("string"), b).alias("diary"))


@query("matter_titles", "select p_partkey, case when p_partkey % 2 = 0 then p_name else p_brand end as title, p_size::varchar || '.' || (p_partkey % 7)::varchar as number, coalesce(nullif(case when p_partkey % 4 = 0 then p_type else '' end, ''), 'beslut') as kind, case when p_partkey % 5 = 0 then p_name else 'ring' end as synced from part")
def matter_titles(spark, sf):  # PRJ-11, PRJ-12, PRJ-14, PRS-14
    p = table(spark, sf, "part")
    first = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit("§ "), F.col("p_size").cast("string")))
    head = F.concat(F.lit("§ "), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.lit(" ring"))
    return p.select("p_partkey", keys.first_title(first, F.col("p_brand")).alias("title"), keys.section_number(head).alias("number"), keys.proposal_type(F.when(F.col("p_partkey") % 4 == 0, F.col("p_type")), F.lit(" ")).alias("kind"), keys.title_from_header(F.when(F.col("p_partkey") % 5 == 0, "utan").otherwise(head), F.col("p_name")).alias("synced"))


@query("stable_hash", "select p_partkey, sha256(lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) || chr(31) || lower(p_brand))[1:16] as id from part")
def stable_hash(spark, sf):  # PRJ-18
    return table(spark, sf, "part").select("p_partkey", keys.stable_hash(F.concat(F.lit(" "), F.upper("p_name"), F.lit("  ")), F.col("p_brand")).alias("id"))


@query("slugs", "select doc_id, trim(regexp_replace(strip_accents(lower(replace(text, 'ß', '@'))), '[^a-z0-9]+', '-', 'g'), '-') as slug from documents")
def slugs(spark, sf):  # PRJ-19
    return table(spark, sf, "documents").select("doc_id", keys.slug(F.col("text")).alias("slug"))


@query("iso_dates", """select event_id, strftime(ts, '%Y-%m-%d') as iso, strftime(ts + interval 2 month, '%Y-%m') as later from events""")
def iso_dates(spark, sf):  # PRJ-21, PRJ-22
    months = F.array(*[F.lit(m) for m in keys.MONTHS])
    said = F.concat_ws(" ", F.lit("den"), F.dayofmonth("ts").cast("string"), F.initcap(F.get(months, F.month("ts") - 1)), F.when(F.col("event_id") % 2 == 0, F.year("ts").cast("string")))
    return table(spark, sf, "events").select("event_id", keys.swedish_date(said, F.lit(2024)).alias("iso"), keys.month_shifted(F.col("ts"), 2).alias("later"))


@query("pdf_anchor", "select page_id, regexp_replace(url, '#.*$', '') || '#' || case when page_id % 3 > 0 then 'page=' || (page_id % 3)::varchar || '&' else '' end || 'zoom=100' || case when page_id % 2 = 0 then '&search=två%20ord'.replace('å', '%C3%A5') else '' end as anchor from pages")
def pdf_anchor(spark, sf):  # PRJ-15
    return table(spark, sf, "pages").select("page_id", keys.pdf_anchor(F.col("url"), F.col("page_id") % 3, F.when(F.col("page_id") % 2 == 0, "två ord")).alias("anchor"))


@query("document_enrichment", "select doc_id, coalesce(nullif(lang, 'en'), source) as kind, case when length(text) > 80 then rtrim(text[1:80], ' ') || '…' else text end as preview, coalesce(quality, -1) as quality from documents left join labels using (doc_id)")
def document_enrichment(spark, sf):  # PRJ-16, PRJ-17
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return docs.select("doc_id", F.coalesce(F.nullif(F.col("lang"), F.lit("en")), "source").alias("kind"), keys.preview(F.col("text"), 80).alias("preview"), F.coalesce("quality", F.lit(-1)).alias("quality"))


SAID = ["Motion om skolan", "Budget 2024", "Detaljplan för kvarteret", "Val av ledamot", "Övriga frågor", "Något annat"]
DONE = ["Motionen avslås", "Förslaget bifalls", "Ärendet återremitteras", "bordläggs", "", "Nämnden noterar"]


@query("classifiers", """select o_orderkey, ['motion', 'budget_matter', 'planning_matter', 'appointment', 'question', 'unclassified'][1 + o_custkey % 6] as matter_type,
 ['reject', 'approve', 'refer_back', 'postpone', 'decision_not_extracted', 'other'][1 + o_custkey % 6] as result, ['rejected', 'approved', 'referred_back', 'postponed', 'not_extracted', 'other'][1 + o_custkey % 6] as outcome, case when o_custkey % 6 = 4 then 'low' else 'high' end as confidence,
 case when o_custkey % 3 = 0 then 'styrelse' when o_custkey % 3 = 1 then 'kommunstyrelseutskott' else 'namnd' end as body_type from orders""")
def classifiers(spark, sf):  # PRS-06, PRS-07, PRS-11
    pick = (F.col("o_custkey") % 6).cast("int")
    one = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), pick)
    body = F.get(F.array(F.lit("Kommunstyrelsen"), F.lit("Kommunstyrelsens utskott"), F.lit("Skolnämnden")), (F.col("o_custkey") % 3).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", keys.matter_type(one(SAID), F.lit(None)).alias("matter_type"), keys.result_class(one(DONE)).alias("c"), keys.body_type(body, {"kommunstyrelsen": "styrelse"}).alias("body_type")).select("o_orderkey", "matter_type", "c.*", "body_type")


@query("range_expand", "select s_suppkey, cast(len(list_distinct(range(s_suppkey, s_suppkey + 3) || [s_suppkey + 5])) as integer) as n, s_suppkey + 5 as top from supplier")
def range_expand(spark, sf):  # PRS-19
    s = F.col("s_suppkey")
    said = F.concat(F.lit("Paragraf "), s.cast("string"), F.lit("–"), (s + 2).cast("string"), F.lit(", "), (s + 5).cast("string"), F.lit(" och "), s.cast("string"))
    found = keys.expanded_ranges(said)
    return table(spark, sf, "supplier").select("s_suppkey", F.size(found).alias("n"), F.array_max(found).cast("bigint").alias("top"))


@query("preferred_source_url", "select conv_id, arg_min(text, {'p': (turn % 2)::bigint, 'n': length(text), 't': text}) as best from conversations group by conv_id")
def preferred_source_url(spark, sf):  # PRS-22
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("text", F.struct(F.col("turn") % 2, F.length("text"), "text")).alias("best"))


@query("percent_counts", "select c_custkey, round(greatest(0, c_acctbal) * 365 / 100, 6) as votes, case when c_custkey % 9 <> 0 then printf('%.2f%%', (c_custkey % 7) / (c_custkey % 9)::double * 100) else '0.00%' end as share from customer")
def percent_counts(spark, sf):  # ALLOC-13, PRJ-23
    from rostra.operators.allocation import counts_from_percent

    return table(spark, sf, "customer").select("c_custkey", counts_from_percent(F.col("c_acctbal"), 365).alias("votes"), keys.percent_text(F.col("c_custkey") % 7, F.col("c_custkey") % 9).alias("share"))


@query("clean_fields", "select conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) as clean from conversations")
def clean_fields(spark, sf):  # PRS-13
    broken = F.concat(F.col("text"), F.lit("\n3 (12)\n"))
    return table(spark, sf, "conversations").select("conv_id", "turn", keys.clean_field(broken).alias("clean"))
