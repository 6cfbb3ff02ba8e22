"""Records of protocols and their issues (PRS-05, 09, 10, 12, 16 to 18, 20, 21, PRJ-01, DQ-02 to 05).

Every row of ``part`` is a protocol of its own kind: which header, dates, attendance, sections, votes and decisions it has
follows from its number, so each rule fires for some rows and not for others.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rostra.operators import assembly, extraction, joins, records
from rostra.plans.civic import query, table


def papers(spark, sf):
    """(p_partkey, page, text): two pages for each part."""
    k, p = F.col("p_partkey"), joins.spread(table(spark, sf, "part"), "p_partkey")
    number = lambda c: c.cast("string")
    when = lambda c, x, y="": F.when(c, F.lit(x) if isinstance(x, str) else x).otherwise(F.lit(y) if isinstance(y, str) else y)
    head = F.when(k % 10 == 0, "Protokoll\nKn 1/2020\nKn 2/2020").when(k % 10 == 5, "Protokoll").when(k % 5 == 1, F.concat(F.lit("Protokoll Ks "), number(k), F.lit("/2023"))).otherwise(F.concat(F.lit("Protokoll KS "), number(k), F.lit("/2024")))
    one = F.concat(
        head, F.lit("\n"), when(k % 6 == 0, "Miljönämnden", "Kulturnämnden"), F.lit("\nDatum: 2024-02-0"), when(k % 7 == 0, "4", "3"),
        when(k % 4 == 0, "\nNärvarande\nAnna Berg (S)", "\nNärvarande ledamöter:\nAnna Berg (S)\nBo Ek (M)\nÖvriga\nEva Fors (X)"), F.lit("\n1 (2)"),
    )
    vote = (
        F.when(k % 5 == 0, "Omröstning begärs.").when(k % 5 == 1, "Omröstning genomförs: Ja: 2, 1 nej-röster.")
        .when(k % 5 == 2, "Omröstning genomförs: Ja: 2, 1 nej-röster.\nAnna Berg (S) Ja\nBo Ek (M) ja\nCi Dahl (V) NEJ")
        .when(k % 5 == 3, "Omröstning genomförs: Ja: 3, 1 nej-röster.\nAnna Berg (S) Ja\nBo Ek (M) Ja\nCi Dahl (V) Nej")
        .otherwise("Omröstning genomförs. Votering begärs. Ny omröstning: Ja: 2")
    )
    two = F.concat(
        F.lit("§ 1 Motion om "), "p_name", when(k % 3 == 0, "\nfortsatt rubrik"), F.lit("\nÄrendenummer: Kn "), number(k), F.lit("/2022\nHandläggare: Di Ek\nSammanfattning av ärendet\nEn sak om "), "p_brand",
        F.lit(".\n2 (2)\nYrkanden:\nAnna Berg (S) yrkar bifall till motionen. Anna Berg (S) yrkar bifall igen. Bo Ek (M) och Ci Dahl (V) yrkar "), when(k % 2 == 0, "avslag", "återremiss"), F.lit(".\nReservation\nEj med.\n"),
        F.when(k % 8 > 0, F.concat(F.lit("Omröstning\n"), vote, F.lit("\n"))).otherwise(""),
        F.lit("Beslut\n"), when(k % 2 == 0, "Nämnden beslutar att\n1. Motionen bifalls\n2. Utse ledamot", "Motionen avslås."), F.lit("\n§ "), when(k % 10 == 3, "1", "2"), F.lit(" Val\nBeslut\nÄrendet bordläggs."),
    )
    return p.select("p_partkey", F.posexplode(F.array(one, F.when(k % 9 > 0, two).otherwise("Inga ärenden"))).alias("n", "text")).select("p_partkey", (F.col("n") + 1).alias("page"), "text")


@query("protocol_records", """with k as (select p_partkey as k, p_name, p_brand from part where p_partkey % 9 > 0)
 select k as p_partkey, '1' as section, 'Motion om ' || p_name || case when k % 3 = 0 then ' fortsatt rubrik' else '' end as title, 'Kn ' || k::varchar || '/2022' as diary, 'En sak om ' || p_brand || '.' as ad, 'motion' as matter_type,
   case when k % 2 = 0 then 'approve' else 'reject' end as result, cast(case when k % 2 = 0 then 2 else 1 end as integer) as n_points, k % 8 > 0 as held,
   cast(case when k % 8 = 0 or k % 5 = 0 then null when k % 5 = 3 then 3 else 2 end as integer) as yes, cast(case when k % 8 > 0 and k % 5 between 1 and 3 then 1 end as integer) as no, cast(case when k % 8 > 0 and k % 5 in (2, 3) then 3 else 0 end as integer) as n_named from k
 union all select k, case when k % 10 = 3 then '1' else '2' end, 'Val', '', '', 'unclassified', 'postpone', 1, false, null, null, 0 from k""")
def protocol_records(spark, sf):  # PRS-05, PRS-10, PRS-12
    made = records.protocol_records(papers(spark, sf), "p_partkey", "page", "text")
    return made.select("p_partkey", "section", "title", "diary", "ad", "matter_type", "result", "n_points", "held", "stated.yes", "stated.no", F.size("named").alias("n_named"))


@query("protocol_issues", """with k as (select p_partkey as k from part), s as (select * from k where k % 9 > 0), i as (
 select k, '' as section, 'date_mismatch' as code from k where k % 7 = 0 union all select k, '', 'protocol_diary_missing' from k where k % 10 in (0, 5) union all select k, '', 'protocol_diary_mismatch' from k where k % 10 in (1, 6)
 union all select k, '', 'body_mismatch' from k where k % 6 = 0 union all select k, '', 'sections_not_found' from k where k % 9 = 0 union all select k, '', 'duplicate_sections' from s where k % 10 = 3
 union all select k, '', 'attendance_not_extracted' from k where k % 4 = 0 union all select k, '1', 'vote_not_resolved' from s where k % 8 > 0 and k % 5 = 0 union all select k, '1', 'named_vote_list_not_extracted' from s where k % 8 > 0 and k % 5 in (1, 4)
 union all select k, '1', 'vote_point_mapping_ambiguous' from s where k % 8 > 0 and k % 2 = 0 union all select k, '1', 'multiple_vote_events_possible' from s where k % 8 > 0 and k % 5 = 4 union all select k, '1', 'vote_tally_conflict' from s where k % 8 > 0 and k % 5 = 3)
 select k as p_partkey, section, code, case code when 'sections_not_found' then 'error' else 'review' end as severity from i""")
def protocol_issues(spark, sf):  # PRS-12, DQ-01 to 05
    pages = papers(spark, sf)
    known = table(spark, sf, "part").select("p_partkey", F.lit("2024-02-03").alias("date"), F.concat(F.lit("Ks "), F.col("p_partkey").cast("string"), F.lit("/2024")).alias("diary"), F.lit("Kulturnämnden").alias("body"))
    return records.protocol_issues(pages, known, records.protocol_records(pages, "p_partkey", "page", "text"), "p_partkey", "page", "text")


def known_protocols(spark, sf):
    """What is known of each part's protocol. Some name the sections they want, some a section's own url."""
    k = F.col("p_partkey")
    none = F.array().cast("array<string>")
    return table(spark, sf, "part").select(
        k, F.lit("2024-02-03").alias("date"), F.when(k % 4 == 0, "Kulturnämnden").when(k % 4 == 1, "Kommunstyrelsen").otherwise("Kommunstyrelsens utskott Å").alias("body"), F.concat(F.lit("2024-02-03 Protokoll "), k.cast("string")).alias("title"), F.concat(F.lit("https://example.org/"), k.cast("string")).alias("url"),
        F.concat(F.lit("p/"), k.cast("string"), F.lit(".pdf")).alias("path"), F.when(k % 12 == 1, F.array(F.lit("1"))).when(k % 12 == 2, F.array(F.lit("2"), F.lit("7"))).otherwise(none).alias("include"),
        F.when(k % 5 == 0, F.create_map(F.lit("1"), F.lit("https://example.org/s1"))).alias("section_urls"),
    )


ASSEMBLED = """k as (select p_partkey as k, p_name, p_brand from part where p_partkey % 9 > 0),
 s as (select k, 1 as s, '1' as section, 'Motion om ' || p_name || case when k % 3 = 0 then ' fortsatt rubrik' else '' end as title, 'Kn ' || k::varchar || '/2022' as diary, case when k % 2 = 0 then [('1.1', 'Nämnden beslutar att Motionen bifalls'), ('1.2', 'Nämnden beslutar att Utse ledamot')] else [('1', 'Motionen avslås.')] end as points, 'motion' as mt, k % 8 > 0 as held from k
  union all select k, 2, case when k % 10 = 3 then '1' else '2' end, 'Val', '', [(case when k % 10 = 3 then '1' else '2' end, 'Ärendet bordläggs.')], 'unclassified', false from k),
 w as (select *, case k % 4 when 0 then 'Kulturnämnden' when 1 then 'Kommunstyrelsen' else 'Kommunstyrelsens utskott Å' end as body, case k % 4 when 0 then 'kulturnamnden' when 1 then 'kommunstyrelsen' else 'kommunstyrelsens_utskott_a' end as key, case when k % 5 = 0 and section = '1' then 'https://example.org/s1' else 'https://example.org/' || k::varchar end as url from s where k % 12 not in (1, 2) or (k % 12 = 1 and section = '1') or (k % 12 = 2 and section = '2')),
 d as (select *, 'case_body_' || key || '_2024_02_03_' || section || case when row_number() over (partition by k, section order by s) > 1 then '_' || sha256(lower(url) || chr(31) || section || chr(31) || lower(title))[1:8] else '' end as id, 'matter_' || sha256(lower(body) || chr(31) || lower(case when diary <> '' then diary else title end))[1:16] as matter from w),
 p as (select *, unnest(points) as x, unnest(range(len(points))) as nth from d)"""


@query("protocol_documents", f"""with {ASSEMBLED}
 select k as p_partkey, id, matter, x[1] as point, x[2] as text, 'decision_point_' || sha256(id || chr(31) || x[1] || chr(31) || lower(x[2]))[1:16] as point_id, '§ ' || section || ' ' || title as header, url as source_url, 'p/' || k::varchar || '.pdf' as path, case k % 4 when 0 then 'namnd' when 1 then 'kommunstyrelsen' else 'kommunstyrelseutskott' end as kind,
  mt as matter_type, case when mt = 'unclassified' then mt else 'classified' end as state, 'final_decision' as level, 'formal_decision' as status, 2::bigint as page, case when held then 'vote_' || id || '_1' end as event,
  cast(case when held and k % 5 > 0 then case when k % 5 = 3 then 3 else 2 end end as integer) as stated_yes, case when held then case when k % 5 in (2, 3) then 'held_roll_call' else 'held_tally_only' end end as vote_status, cast(case when held and k % 5 in (2, 3) then 3 else 0 end as integer) as n_ballots,
  case when held and k % 5 in (2, 3) then points[1][1] || ' Ci Dahl vote_' || id || '_1:3' end as last_ballot from p""")
def protocol_documents(spark, sf):  # PRS-12: assembly
    made = assembly.documents(records.protocol_records(papers(spark, sf), "p_partkey", "page", "text"), known_protocols(spark, sf), "p_partkey")
    rows = made.select("*", F.explode("p").alias("point", "text"))
    meta, event = F.element_at("pm", F.col("point")), F.try_element_at("v", F.col("point"))
    last = F.get("votes", F.size("votes") - 1)
    return rows.select(
        "p_partkey", F.col("i").alias("id"), F.col("mi").alias("matter"), "point", "text", meta["decision_point_id"].alias("point_id"), F.col("ht").alias("header"), F.col("u").alias("source_url"), F.col("lp").alias("path"), F.col("bt").alias("kind"),
        meta["matter_type"].alias("matter_type"), meta["matter_type_state"].alias("state"), meta["decision_level"].alias("level"), meta["extraction_status"].alias("status"), meta["source_page"].cast("bigint").alias("page"), event.alias("event"),
        meta["stated_yes"].alias("stated_yes"), F.try_element_at("ve", event)["vote_status"].alias("vote_status"), F.size("votes").alias("n_ballots"), F.when(F.size("votes") > 0, F.concat_ws(" ", last["point"], last["name"], last["participant"])).alias("last_ballot"),
    )


@query("supplement_issues", """select p_partkey, x as section, 'supplement_sections_missing' as code, 'review' as severity from (select p_partkey, unnest(case when p_partkey % 12 = 1 then ['1'] else ['2', '7'] end) as x from part where p_partkey % 12 in (1, 2))
 where p_partkey % 9 = 0 or x = '7' or (x = '2' and p_partkey % 10 = 3)""")
def supplement_issues(spark, sf):  # PRS-12: wanted sections
    known = known_protocols(spark, sf)
    return assembly.supplement_issues(assembly.documents(records.protocol_records(papers(spark, sf), "p_partkey", "page", "text"), known, "p_partkey"), known, "p_partkey")


@query("record_positions", """with k as (select p_partkey as k from part where p_partkey % 9 > 0), v as (select 'Anna Berg' as name, 'S' as party, 'Bifallsyrkande' as a, 'Bifallsyrkande' as b union all select 'Bo Ek', 'M', 'Avslagsyrkande', 'Återremissyrkande' union all select 'Ci Dahl', 'V', 'Avslagsyrkande', 'Återremissyrkande'),
 r as (select k, name, party, case when k % 2 = 0 then a else b end as stance, case when name = 'Anna Berg' then 'bifall till motionen' when k % 2 = 0 then 'avslag' else 'återremiss' end as request from k, v)
 select k as p_partkey, '1' as point, name, party, stance, 'proposal_' || sha256(lower(k::varchar || chr(31) || '1' || chr(31) || name || chr(31) || party || chr(31) || request))[1:16] as proposal from r""")
def record_positions(spark, sf):  # PRS-09
    sections = records.section_fields(records.section_lines(papers(spark, sf), "p_partkey", "page", "text"), "p_partkey").where("yd <> ''").withColumnRenamed("section", "point")
    return extraction.positions(sections, ["p_partkey", "point"], "yd")


@query("inferred_votes", """with k as (select p_partkey as k from part)
 select k as p_partkey, cast(2 as integer) as yes, cast(case k % 3 when 0 then 1 when 1 then 2 end as integer) as no, k % 3 = 0 and k % 4 > 0 as accepted, cast(case when k % 3 = 0 and k % 4 > 0 then 3 else 0 end as integer) as n_named from k""")
def inferred_votes(spark, sf):  # PRS-16
    k = F.col("p_partkey")
    said = F.concat(
        F.lit("Omröstning genomförs med 2 ja-röster"), F.when(k % 3 == 0, " och 1 nej-röst").when(k % 3 == 1, " och 2 nej-röster").otherwise(""), F.lit(". Ja-röster: Anna Berg (S)"),
        F.when(k % 4 == 0, "").otherwise(" och Bo Ek (M)"), F.lit(". Nej-röst: Ci Dahl (V)."),
    )
    v = records.inferred_votes(said)
    return table(spark, sf, "part").select("p_partkey", v["yes"].alias("yes"), v["no"].alias("no"), v["accepted"].alias("accepted"), F.size(v["named"]).alias("n_named"))


PARAGRAPHS = r"""said as (select p_partkey as k, case when p_partkey % 5 = 0 then ['7'] else ['12', '12.1', '12.2'] end as known, case when p_partkey % 7 = 0 then ['12.2'] else [] end as has,
  'Ärendet. Beslutspunkt 1 behandlas. Votering ' || case when p_partkey % 11 = 0 then 'begärdes och verkställdes.' else 'begärs och  verkställs.' end || ' Ja-röst innebär ' || p_name || '. Nej-röst innebär avslag på motionen. Ja-röster lämnas av Anna Berg (S) och Bo Ek (M). Nej-röster lämnas av Ci Dahl (V).' || chr(10)
  || 'Ordföranden finner resultatet 2 ja-röster och ' || case when p_partkey % 3 = 0 then '2' else '1' end || ' nej-röster. Beslutspunkt 2 är nästa. VOTERING begärdes och verkställdes. Ja-röst innebär Bifall enligt ' || p_brand || '. Nej- röst innebär ' || p_type || '. '
  || case when p_partkey % 4 = 0 then '' else 'Ja-röster lämnas av Eva - Lena Ås (MP). Nej-röster lämnas av Bo Ek (M), Ci Dahl (V) och Åke' || chr(10) || ' Öst (KD).' || chr(10) end || 'Ordföranden finner resultatet 1 ja-röster och 3 nej-röster. '
  || case when p_partkey % 6 = 0 then 'Votering begärs och verkställs. Ja-röst innebär a. Nej-röst innebär b. Ja-röster lämnas av A B (S). Nej-röster lämnas av C D (M). Resultatet 1 ja-röster och 1 nej-röster.' else '' end as text from part),
 segs as (select *, string_split(regexp_replace(text, '(votering\s+beg(?:ä|a)r(?:s|des)?\s+och\s+verkst(?:ä|a)ll(?:s|des)?\s*\.?)', chr(1) || '\1', 'gi'), chr(1)) as parts from said where contains(regexp_replace(lower(text), '\s+', ' ', 'g'), 'votering begärs och verkställs')),
 each as (select k, known, has, i, parts[i] as s, right(array_to_string(parts[1:i - 1], ''), 2400) as before from (select *, unnest(range(2, len(parts) + 1)) as i from segs)),
 cut as (select *, regexp_extract_all(before, 'beslutspunkt\s+([0-9]+)', 1, 'i')[-1] as num, regexp_extract(s, 'Ja-r(?:ö|o)st\s+inneb(?:ä|a)r\s+(.+?)\.\s*Nej-?\s*r(?:ö|o)st\s+inneb(?:ä|a)r\s+(.+?)\.\s*(?:Ja-r(?:ö|o)ster|Nej-r(?:ö|o)ster|Ordf(?:ö|o)rande|resultatet)', ['y', 'n'], 'is') as m,
   regexp_extract(s, 'Ja-r(?:ö|o)ster\s+l(?:ä|a)mnas\s+av\s+(.+?)\.\s*Nej-r(?:ö|o)ster\s+l(?:ä|a)mnas\s+av\s+(.+?)(?:\.|\nOrdf(?:ö|o)rande)', ['y', 'n'], 'is') as p, regexp_extract(s, 'resultatet\s+([0-9]+)\s+ja-r(?:ö|o)ster\s+och\s+([0-9]+)\s+nej-r(?:ö|o)ster', ['y', 'n'], 'i') as r from each),
 who as (select *, coalesce(list_filter(known, lambda x: x = split_part(known[1], '.', 1) || '.' || num)[1], list_filter(known, lambda x: ends_with(x, '.' || num) or x = num)[1], case when len(known) = 1 then known[1] end) as point,
   list_transform(regexp_extract_all(regexp_replace(trim(regexp_replace(p.y, '\s+', ' ', 'g')), '\s+-\s*', '-', 'g'), '[^,;.]+?\s*\([A-Za-zÅÄÖåäö]+\)'), lambda x: {{'name': regexp_replace(trim(split_part(x, '(', 1)), '^och\s+', '', 'i'), 'party': split_part(split_part(x, '(', 2), ')', 1)}}) as yes_people,
   list_transform(regexp_extract_all(regexp_replace(trim(regexp_replace(p.n, '\s+', ' ', 'g')), '\s+-\s*', '-', 'g'), '[^,;.]+?\s*\([A-Za-zÅÄÖåäö]+\)'), lambda x: {{'name': regexp_replace(trim(split_part(x, '(', 1)), '^och\s+', '', 'i'), 'party': split_part(split_part(x, '(', 2), ')', 1)}}) as no_people,
   case when regexp_matches(m.y, '^(bifall|avslag)\b', 'i') then m.y else 'bifall till ' || m.y end as yes_meaning, case when regexp_matches(m.n, '^(bifall|avslag)\b', 'i') then m.n else 'bifall till ' || m.n end as no_meaning, try_cast(r.y as integer) as yes, try_cast(r.n as integer) as no from cut),
 fine as (select *, row_number() over (partition by k order by i) as nth from who where point is not null and not list_contains(has, point) and m.y <> '' and yes > 0 and no > 0 and len(yes_people) = yes and len(no_people) = no),
 votes as (select *, 'vote_doc_' || k::varchar || '_' || replace(point, '.', '_') || '_inferred_' || nth::varchar as event from fine qualify row_number() over (partition by k, point order by i) = 1)""".replace("{{", "{").replace("}}", "}")


def paragraph_documents(spark, sf):
    k, n, s = F.col("p_partkey"), F.lit("\n"), F.lit
    marker = F.when(k % 11 == 0, "begärdes och verkställdes.").otherwise("begärs och  verkställs.")
    named = F.when(k % 4 == 0, "").otherwise("Ja-röster lämnas av Eva - Lena Ås (MP). Nej-röster lämnas av Bo Ek (M), Ci Dahl (V) och Åke\n Öst (KD).\n")
    third = "Votering begärs och verkställs. Ja-röst innebär a. Nej-röst innebär b. Ja-röster lämnas av A B (S). Nej-röster lämnas av C D (M). Resultatet 1 ja-röster och 1 nej-röster."
    said = F.concat(
        s("Ärendet. Beslutspunkt 1 behandlas. Votering "), marker, s(" Ja-röst innebär "), F.col("p_name"), s(". Nej-röst innebär avslag på motionen. Ja-röster lämnas av Anna Berg (S) och Bo Ek (M). Nej-röster lämnas av Ci Dahl (V)."), n,
        s("Ordföranden finner resultatet 2 ja-röster och "), F.when(k % 3 == 0, "2").otherwise("1"), s(" nej-röster. Beslutspunkt 2 är nästa. VOTERING begärdes och verkställdes. Ja-röst innebär Bifall enligt "), F.col("p_brand"), s(". Nej- röst innebär "), F.col("p_type"), s(". "),
        named, s("Ordföranden finner resultatet 1 ja-röster och 3 nej-röster. "), F.when(k % 6 == 0, third).otherwise(""),
    )
    texts = lambda *ps: F.map_from_arrays(F.array(*map(F.lit, ps)), F.array(*[F.lit("x")] * len(ps)))
    return joins.spread(table(spark, sf, "part"), "p_partkey").select(k, F.concat(s("doc "), k.cast("string")).alias("name"), said.alias("text"), F.when(k % 5 == 0, texts("7")).otherwise(texts("12", "12.1", "12.2")).alias("p"), F.when(k % 7 == 0, texts("12.2")).alias("v"))


@query("paragraph_votes", f"with {PARAGRAPHS} select k as p_partkey, point, event, yes_meaning, no_meaning, yes, no from votes")
def paragraph_votes(spark, sf):  # PRS-16: events
    return records.paragraph_votes(paragraph_documents(spark, sf), "p_partkey", "name", "text", "p", "v").drop("yes_people", "no_people")


@query("paragraph_ballots", f"""with {PARAGRAPHS}, b as (select k, point, event, 'Ja' as vote, 'yes' as side, unnest(yes_people) as who, unnest(range(1, len(yes_people) + 1)) as n from votes union all select k, point, event, 'Nej', 'no', unnest(no_people), unnest(range(1, len(no_people) + 1)) from votes)
 select k as p_partkey, point, event, who.name as name, who.party as party, vote, event || ':' || side || '_' || n::varchar as participant from b""")
def paragraph_ballots(spark, sf):  # PRS-16: ballots
    return records.paragraph_ballots(records.paragraph_votes(paragraph_documents(spark, sf), "p_partkey", "name", "text", "p", "v"), "p_partkey")


@query("result_reconciled", """with k as (select p_partkey as k from part)
 select k as p_partkey, case k % 6 when 0 then 'Ansökan beviljas' when 1 then 'Ansökan avslås' when 2 then 'Ansökan beviljas inte' when 3 then 'Förening A får 5 000 kr' when 4 then '' else 'Utse ledamot' end as line,
   case k % 6 when 0 then 'approved' when 1 then 'reject' when 2 then case when k % 2 = 0 and k % 4 = 0 then 'approved' when k % 2 = 0 then 'reject' end when 3 then case when k % 4 < 2 then 'approved' else 'approve' end when 4 then case when k % 4 < 2 then 'reject' else 'approve' end
     else case when k % 4 < 2 then 'reject' else 'approve' end end as result from k""")
def result_reconciled(spark, sf):  # PRS-17
    k = F.col("p_partkey")
    line = F.get(F.array(*[F.lit(x) for x in ("Ansökan beviljas", "Ansökan avslås", "Ansökan beviljas inte", "Förening A får 5 000 kr", "", "Utse ledamot")]), (k % 6).cast("int"))
    decision = F.concat(F.lit("Nämnden beslutar\n1. Bidrag beviljas A\n2. "), line, F.lit("\nJäv\nEj med\n3. Bidrag beviljas B"))
    stated = F.when((k % 6 == 0) | (k % 4 < 2), "reject").otherwise("approve")
    found = records.final_line(decision, F.when(k % 6 == 4, "7.9").otherwise("7.2"))
    return table(spark, sf, "part").select("p_partkey", found.alias("line"), decision.alias("d"), stated.alias("s")).select("p_partkey", "line", records.reconciled_result(F.col("s"), F.col("d"), F.col("line")).alias("result"))


PHRASES = (("grundskolenämnden", "grundskolenamnden"), ("skolenämnden", "skolenamnden"), ("miljönämnden", "miljonamnden"))


@query("committee_cover", """with k as (select p_partkey as k from part)
 select k as p_partkey, case when k % 5 = 0 or k % 3 = 2 then '' else case k % 4 when 0 then 'grundskolenamnden' when 1 then 'skolenamnden' when 2 then 'miljonamnden' else '' end end as body from k""")
def committee_cover(spark, sf):  # PRS-18
    k = F.col("p_partkey")
    body = F.get(F.array(*[F.lit(x) for x in ("GRUNDSKOLENÄMNDEN", "Skolenämnden  och Miljönämnden", "Protokoll miljönämnden", "Någon annan")]), (k % 4).cast("int"))
    date = F.when(k % 5 == 0, "Datum: i dag").otherwise("Datum: 2024-02-03")
    rest = F.when(k % 3 == 0, "Närvarande: Anna").when(k % 3 == 1, "Tid: 9\nPlats: salen").otherwise("Tid: 9")
    return table(spark, sf, "part").select("p_partkey", records.cover_body(F.concat_ws("\n", body, date, rest), PHRASES).alias("body"))


@query("part_dedupe", """with p as (select o_custkey as g, o_orderkey as part, o_orderkey % 4 as pages, o_orderkey % 2 as rank, case when o_orderkey % 5 > 0 then (o_orderkey % 7)::varchar else '' end as sig, o_orderkey % 6 as a, o_orderkey % 11 as d from orders),
 c as (select *, case when a > 0 then list_sort(list_distinct([a, a + d % 3])) else [] end as sections, case when d > 6 then [d] else [] end as declared from p),
 n as (select *, case when len(declared) > 0 then declared else sections end as num, row_number() over (partition by g order by coalesce(list_min(case when len(declared) > 0 then declared else sections end), 1000000), -pages, rank, part) as i from c)
 select g, count(*) as parts, count(*) filter (i = 1) as first_kept, min(case when i = 1 then part end) as first from n group by g""")
def part_dedupe(spark, sf):  # PRS-21: what the first choice is; all choices are tested against a scan by hand
    parts = meeting_parts(spark, sf)
    kept = records.deduplicated_parts(parts, "g")
    first = F.coalesce(F.array_min(F.when(F.col("d") > 6, F.array("d")).when(F.col("a") > 0, F.array("a"))), F.lit(1_000_000))
    head = parts.groupBy("g").agg(F.min_by("part", F.struct(first, F.negative("pages"), "rank", "part")).alias("head"))
    both = parts.join(kept, ["g", "part"]).join(head, "g")
    best = F.min_by("part", F.when(F.col("kept"), F.struct(first, F.negative("pages"), "rank", "part")))
    return both.groupBy("g").agg(F.count("*").alias("parts"), F.count_if(F.col("kept") & (F.col("part") == F.col("head"))).alias("first_kept"), best.alias("first"))


@query("part_dedupe_choices", """with recursive p as (select o_custkey as g, o_orderkey as part, o_orderkey % 4 as pages, o_orderkey % 2 as rank, case when o_orderkey % 5 > 0 then (o_orderkey % 7)::varchar else '' end as sig, o_orderkey % 6 as a, o_orderkey % 11 as d from orders),
 c as (select *, case when a > 0 then list_sort(list_distinct([a, a + d % 3])) else [] end as sections, case when d > 6 then [d] else [] end as declared from p),
 n as (select *, case when len(declared) > 0 then declared else sections end as num, list_concat(list_concat(case when sig <> '' then ['t' || sig] else [] end, case when len(sections) > 0 then ['s' || sections::varchar] else [] end), case when len(declared) > 0 then ['d' || declared::varchar] else [] end) as own from c),
 r as (select *, row_number() over (partition by g order by coalesce(list_min(num), 1000000), -pages, rank, part) as i from n),
 s as (select g, i, part, true as kept, own as seen, [num] as nums, []::bigint[] as shared from r where i = 1
  union all select r.g, r.i, r.part, not list_has_any(s.seen, r.own), case when list_has_any(s.seen, r.own) then s.seen else list_concat(s.seen, r.own) end, case when list_has_any(s.seen, r.own) then s.nums else list_concat(s.nums, [r.num]) end,
   case when list_has_any(s.seen, r.own) then [] else coalesce(list_filter(s.nums, lambda x: list_has_any(x, r.num))[1], []) end from s join r on r.g = s.g and r.i = s.i + 1)
 select s.g, s.part, kept, array_to_string(list_sort(list_intersect(shared, num)), ',') as overlaps from s join r using (g, i)""")
def part_dedupe_choices(spark, sf):  # PRS-21: which parts stay, and what the kept ones share with an earlier one
    kept = records.deduplicated_parts(meeting_parts(spark, sf), "g")
    return kept.select("g", "part", "kept", F.array_join(F.transform("overlaps", lambda x: x.cast("string")), ",").alias("overlaps"))


def meeting_parts(spark, sf):
    k = F.col("o_orderkey")
    a, d = (k % 6).cast("int"), (k % 11).cast("int")
    none = F.array().cast("array<int>")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("g"), k.alias("part"), (k % 4).alias("pages"), (k % 2).alias("rank"), F.when(k % 5 > 0, (k % 7).cast("string")).otherwise("").alias("signature"),
        F.when(a > 0, F.array(a, a + d % 3)).otherwise(none).alias("sections"), F.when(d > 6, F.array(d)).otherwise(none).alias("declared"), a.alias("a"), d.alias("d"),
    )


@query("meeting_groups", """with p as (select n_name as body, cast(o_orderdate as date)::varchar as date, case when o_orderkey % 4 > 0 then case when o_orderkey % 3 = 0 then lower(o_orderpriority) else o_orderpriority end else '' end as diary from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
 g as (select body, date, count(distinct lower(nullif(diary, ''))) as diaries, count(*) filter (diary = '') as missing from p group by 1, 2)
 select *, case when diaries > 1 and missing > 0 then 'diary_missing_beside_several' when diaries > 1 then 'several_diaries' else '' end as error from g""")
def meeting_groups(spark, sf):  # PRS-20
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows, k = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")), F.col("o_orderkey")
    diary = F.when(k % 4 > 0, F.when(k % 3 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority"))).otherwise("")
    return records.meeting_groups(rows.select(F.col("n_name").alias("body"), F.col("o_orderdate").cast("date").cast("string").alias("date"), diary.alias("diary")))


@query("point_rows", """select o_custkey as doc, o_orderkey::varchar as point, 'Beslut ' || o_orderkey::varchar as text, case when o_orderkey % 3 > 0 then o_orderpriority end as kind, case when o_orderkey % 2 = 0 then 'e' || (o_orderkey % 5)::varchar end as event,
 case when o_orderkey % 2 = 0 and o_orderkey % 5 > 0 then (o_orderkey % 5) * 10 end as tally from orders""")
def point_rows(spark, sf):  # PRJ-01
    k, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    pair = lambda cond, value: F.map_from_entries(F.array_compact(F.collect_list(F.when(cond, F.struct(text, value)))))
    tallies = F.map_from_arrays(F.array(*[F.lit(f"e{i}") for i in range(1, 5)]), F.array(*[F.lit(10 * i).cast("bigint") for i in range(1, 5)]))
    docs = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(pair(F.lit(True), F.concat(F.lit("Beslut "), text)).alias("p"), pair(k % 3 > 0, F.struct(F.col("o_orderpriority").alias("kind"))).alias("pm"), pair(k % 2 == 0, F.concat(F.lit("e"), (k % 5).cast("string"))).alias("v")).withColumn("ve", tallies)
    return records.point_rows(docs, ["doc"]).select("doc", "point", "text", "meta.kind", "event", "tally")
