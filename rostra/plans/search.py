"""Text search, people and references (TXT, ENT, REF)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostra.functions import text
from rostra.operators import entities, joins, references, windows
from rostra.operators import token_index as postings
from rostra.plans.civic import ORACLE_SQL, POINTS, points, query, table
from rostra.sources import sinks

#: A token t matches the query token 'widgets' (7 letters: stems of 5, one edit).
TOKEN_MATCH = "(contains(t, 'widgets') or (length(t) >= 6 and t[1:5] = 'widge') or (length(t) >= 4 and abs(length(t) - 7) <= 1 and (t[1] = 'w' or t[-1] = 's') and levenshtein(t, 'widgets') <= 1))"


@query("text_match", f"select p_partkey, contains(p_name, 'widgets') or len(list_filter(list_distinct(string_split(p_name, ' ')), lambda t: length(t) >= 3 and {TOKEN_MATCH})) > 0 as hit from part")
def text_match(spark, sf):  # TXT-03, TXT-04, TXT-05
    return table(spark, sf, "part").select("p_partkey", text.text_matches(F.col("p_name"), "Widgets").alias("hit"))


SCORE = """case when n = 'red widget' then 1000 when a > 0 and b > 0 then greatest(ph, 220 + a + b) else ph end"""
SCORED = """x as (select *, list_distinct(string_split(n, ' ')) as ts, case when strpos(n, 'red widget') = 1 then 900 when strpos(n, 'red widget') > 1 then greatest(620, 780 - least(strpos(n, 'red widget') - 1, 160)) else 0 end as ph from n0),
 y as (select *, coalesce(list_max(list_transform(ts, lambda t: case when t = 'red' then 180 when starts_with(t, 'red') then 155 when contains(t, 'red') then 55 else 0 end)), 0) as a,
  coalesce(list_max(list_transform(ts, lambda t: case when t = 'widget' then 180 when starts_with(t, 'widget') then 155 when starts_with('widget', t) and 6 - length(t) <= 2 then 125
   when length(t) >= 4 and abs(length(t) - 6) <= 1 and levenshtein(t, 'widget') <= 1 then 105 when contains(t, 'widget') or (length(t) >= 6 and t[1:5] = 'widge') then 55 else 0 end)), 0) as b from x)"""


@query("field_score", f"with n0 as (select p_partkey, p_name as n from part), {SCORED} select p_partkey, cast({SCORE} as integer) as score from y")
def field_score(spark, sf):  # TXT-06
    return table(spark, sf, "part").select("p_partkey", text.field_score(F.col("p_name"), "Red widget").alias("score"))


@query("weighted_relevance", f"""with n0 as (select p_partkey, p_name as n, p_type from part), {SCORED}, z as (select p_partkey, {SCORE} * 1.6 as s1, case when lower(p_type) = 'red widget' then 1000 else 0 end * 0.7 as s2 from y)
 select p_partkey, round(greatest(s1, s2) + least(0.08 * (s1 + s2 - greatest(s1, s2)), 250), 6)::double as relevance from z""")
def weighted_relevance(spark, sf):  # TXT-07
    return table(spark, sf, "part").select("p_partkey", F.round(text.weighted_score("red widget", [(F.col("p_name"), 1.6), (F.col("p_type"), 0.7)]), 6).alias("relevance"))


@query("dropdown_rank", """with n as (select p_partkey, lower(p_brand) as brand, p_name as n from part)
 select p_partkey, cast(case when n = 'widget' then 100000 when starts_with(n, 'widget') then 90000 - least(1000, length(n)) when len(list_filter(string_split(n, ' '), lambda w: starts_with(w, 'widget'))) > 0
   then 80000 - 100 * (list_position(list_transform(string_split(n, ' '), lambda w: starts_with(w, 'widget')), true) - 1) - least(99, length(list_filter(string_split(n, ' '), lambda w: starts_with(w, 'widget'))[1]))
   when contains(n, 'widget') then 70000 - least(1000, 10 * (strpos(n, 'widget') - 1)) - least(99, length(n)) else 0 end as integer) as score from n""")
def dropdown_rank(spark, sf):  # TXT-09
    return table(spark, sf, "part").select("p_partkey", text.dropdown_score(F.col("p_name"), "widget").cast("int").alias("score"))


@query("keyword_contains_all", "select doc_id, contains(n, 'the with') or (contains(n, 'the') and contains(n, 'with')) as hit from (select doc_id, trim(regexp_replace(strip_accents(lower(replace(text, 'ß', '@'))), '[^a-z0-9]+', ' ', 'g')) as n from documents)")
def keyword_contains_all(spark, sf):  # TXT-10
    return table(spark, sf, "documents").select("doc_id", text.contains_all(F.col("text"), "the with").alias("hit"))


@query("ranked_search", """with n as (select doc_id, source, trim(regexp_replace(strip_accents(lower(replace(text, 'ß', '@'))), '[^a-z0-9]+', ' ', 'g')) as n from documents where lang in ('en', 'fr')),
 s as (select doc_id, source, case when n = 'license' then 1000 else greatest(case when strpos(n, 'license') = 1 then 900 when strpos(n, 'license') > 1 then greatest(620, 780 - least(strpos(n, 'license') - 1, 160)) else 0 end,
   case when m > 0 then 220 + m else 0 end) end as score from (select *, coalesce(list_max(list_transform(list_distinct(string_split(n, ' ')), lambda t: case when t = 'license' then 180 when starts_with(t, 'license') then 155
     when t <> '' and starts_with('license', t) and 7 - length(t) <= 2 then 125 when length(t) >= 4 and abs(length(t) - 7) <= 1 and levenshtein(t, 'license') <= 1 then 105 when contains(t, 'license') or (length(t) >= 6 and t[1:5] = 'licen') then 55 else 0 end)), 0) as m from n))
 select doc_id, source, cast(score as integer) as score, cast(row_number() over (order by score desc, doc_id) as integer) as rank from s where score > 0 qualify rank <= 50""")
def ranked_search(spark, sf):  # FLT-10, SRT-03, SRT-08
    """Facets first; then texts are scored by their distinct tokens, each of which is scored once where it can match at all;
    only the best rows of each partition travel."""
    docs = table(spark, sf, "documents").where(F.col("lang").isin("en", "fr"))
    return windows.top_k(text.scored(docs, "doc_id", "text", "license", ["source"]), [F.desc("score"), F.asc("doc_id")], 50)


_INDEXES: dict[tuple, str] = {}


def document_index(spark, sf):
    """The index of a folder's documents, written once in a session while their files stay the same."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/documents.parquet")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    now = (spark.sparkContext.applicationId, sf, fs.getContentSummary(at).getLength(), fs.getFileStatus(at).getModificationTime())
    if now not in _INDEXES:
        _INDEXES[now] = postings.write_index(table(spark, sf, "documents"), "doc_id", "text", sinks.scratch_path(spark), ["lang", "source"])
    return _INDEXES[now]


@query("indexed_search", ORACLE_SQL["ranked_search"])
def indexed_search(spark, sf):  # TXT-11: as ranked_search, by postings
    found = postings.search(spark, document_index(spark, sf), "license", "doc_id", ["source"], F.col("lang").isin("en", "fr"))
    return windows.top_k(found, [F.desc("score"), F.asc("doc_id")], 50)


@query("indexed_phrase", """with n as (select doc_id, trim(regexp_replace(strip_accents(lower(replace(text, 'ß', '@'))), '[^a-z0-9]+', ' ', 'g')) as n from documents), t as (select doc_id, n, list_distinct(string_split(n, ' ')) as ts from n),
 m as (select doc_id, n, [coalesce(list_max(list_transform(ts, lambda t: case when t = p then 180 when starts_with(t, p) then 155 when length(p) >= 5 and t <> '' and starts_with(p, t) and length(p) - length(t) <= 2 then 125
    when length(p) >= 4 and length(t) >= 4 and abs(length(t) - length(p)) <= 1 and levenshtein(t, p) <= 1 then 105 when contains(t, p) then 55 else 0 end)), 0) for p in ['the', 'open']] as b from t)
 select doc_id, cast(case when n = 'the open' then 1000 else greatest(case when strpos(n, 'the open') = 1 then 900 when strpos(n, 'the open') > 1 then greatest(620, 780 - least(strpos(n, 'the open') - 1, 160)) else 0 end, case when b[1] > 0 and b[2] > 0 then 220 + b[1] + b[2] else 0 end) end as integer) as score
 from m where case when strpos(n, 'the open') > 0 then 1 when b[1] > 0 and b[2] > 0 then 1 else 0 end = 1""")
def indexed_phrase(spark, sf):  # TXT-11, TXT-06: every text that scores for two words, as a phrase or apart
    return postings.search(spark, document_index(spark, sf), "The open", "doc_id")


@query("quick_prefilter", f"select p_partkey from part where contains(lower(p_brand), 'widgets') or contains(p_name, 'widgets') or len(list_filter(list_distinct(string_split(p_name, ' ')), lambda t: length(t) >= 3 and {TOKEN_MATCH})) > 0")
def quick_prefilter(spark, sf):  # TXT-08
    return table(spark, sf, "part").where(text.quick_match([F.col("p_brand"), F.col("p_type")], F.col("p_name"), "widgets")).select("p_partkey")


@query("token_index", """with t as (select doc_id, unnest(list_distinct(list_filter(string_split(trim(regexp_replace(strip_accents(lower(replace(text, 'ß', '@'))), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 3))) as t from documents)
 select length(t) as size, t[1:5] as prefix, count(*) as n, count(distinct t) as kinds from t group by 1, 2""")
def token_index(spark, sf):  # TXT-11
    each = table(spark, sf, "documents").select("doc_id", F.explode(text.tokens(text.normalize_text(F.col("text")), 3)).alias("t"))
    return each.groupBy(F.length("t").cast("bigint").alias("size"), F.substring("t", 1, 5).alias("prefix")).agg(F.count("*").alias("n"), F.count_distinct("t").alias("kinds"))


@query("source_text_verified", """with c as (select conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w, regexp_replace(text, '\\s+', ' ', 'g') as src from conversations)
 select conv_id, turn, len(list_filter([0, 1, 2, 3], lambda i: contains(src, array_to_string(w[1 + i * (len(w) // 4) : i * (len(w) // 4) + greatest(3, least(12, len(w) // 4))], ' ')))) >= 2 as verified from c""")
def source_text_verified(spark, sf):  # TXT-12
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w"), F.regexp_replace("text", r"\s+", " ").alias("src"))
    step = F.floor(F.size("w") / 4).cast("int")
    window = lambda i: F.array_join(F.slice("w", 1 + i * step, F.greatest(F.lit(3), F.least(F.lit(12), step))), " ")
    found = sum((F.contains("src", window(i)).cast("int") for i in range(4)), F.lit(0))
    return c.select("conv_id", "turn", (found >= 2).alias("verified"))


@query("text_blocks", r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents),
 m as (select *, regexp_matches(line, '^\s*([-•*–]|[0-9]{1,2}[.)])\s+') as item, regexp_full_match(line, '\s*') as blank from l), b as (select *, not blank and (item or coalesce(lag(blank) over (partition by doc_id order by i), true)) as starts from m),
 g as (select *, sum(starts::int) over (partition by doc_id order by i) as g from b where not blank)
 select doc_id, cast(g - 1 as integer) as pos, case when bool_or(item) then 'item' else 'paragraph' end as kind, string_agg(trim(regexp_replace(line, case when item then '^\s*([-•*–]|[0-9]{1,2}[.)])\s+' else '^\s+' end, ''), chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), ' ' order by i) as text from g group by doc_id, g""")
def text_blocks(spark, sf):  # TXT-13; an Arrow function
    from rostra.operators.extraction import text_blocks as blocks

    return table(spark, sf, "documents").select("doc_id", F.posexplode(blocks("text")).alias("pos", "b")).select("doc_id", "pos", "b.*")


PEOPLE = """people as (select p_type as party, p_brand as body, case when p_partkey % 9 = 0 then p_name || 'n' when p_partkey % 11 = 0 then replace(p_name, 'e', 'é') else p_name end as name from part)"""


def people(spark, sf):
    name = F.when(F.col("p_partkey") % 9 == 0, F.concat("p_name", F.lit("n"))).when(F.col("p_partkey") % 11 == 0, F.regexp_replace("p_name", "e", "é")).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select(F.col("p_type").alias("party"), F.col("p_brand").alias("body"), name.alias("name"))


NAME_KEYS = ("aero bech olsen", "asa oberg", "zoe ek", "", "", "liv maj as", "ordforandes kalle", "")


@query("person_keys", """with r as (select c_custkey, ['Åsa', 'Øyvind', 'Éva', 'Anna-Lena'][1 + c_custkey % 4] || ' ' || case when c_custkey % 3 = 0 then 'Sæther-' else '' end || replace(c_name, '#', '') as raw from customer),
 d as (select *, case c_custkey % 7 when 1 then '2024-01-02 ' || raw when 2 then 'Ordförande ' || raw when 3 then raw || ', politisk sekreterare' when 4 then 'Ersätter ' || raw when 5 then replace(raw, ' ', '  ') when 6 then replace(raw, '-', '–') else raw end as said from r),
 c as (select *, regexp_replace(regexp_replace(regexp_replace(said, '^[0-9]{4}-[0-9]{2}-[0-9]{2} ', ''), '^Ordförande ', ''), ', politisk sekreterare$', '') as clean from d)
 select c_custkey, case when starts_with(said, 'Ersätter') then '' else trim(regexp_replace(regexp_replace(strip_accents(replace(replace(replace(replace(lower(clean), '–', ' '), '-', ' '), 'ø', 'o'), 'æ', 'ae')), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) end as key from c""")
def person_keys(spark, sf):  # ENT-01
    k = F.col("c_custkey")
    first = F.get(F.array(*[F.lit(x) for x in ("Åsa", "Øyvind", "Éva", "Anna-Lena")]), (k % 4).cast("int"))
    raw = F.concat(first, F.lit(" "), F.when(k % 3 == 0, "Sæther-").otherwise(""), F.replace("c_name", F.lit("#"), F.lit("")))
    said = (
        F.when(k % 7 == 1, F.concat(F.lit("2024-01-02 "), raw)).when(k % 7 == 2, F.concat(F.lit("Ordförande "), raw)).when(k % 7 == 3, F.concat(raw, F.lit(", politisk sekreterare"))).when(k % 7 == 4, F.concat(F.lit("Ersätter "), raw))
        .when(k % 7 == 5, F.replace(raw, F.lit(" "), F.lit("  "))).when(k % 7 == 6, F.replace(raw, F.lit("-"), F.lit("–"))).otherwise(raw)
    )
    return table(spark, sf, "customer").select("c_custkey", entities.person_key(said).alias("key"))


@query("reviewed_names", "select c_custkey, case when c_custkey % 4 = 0 then 'Åsa Öberg' when c_custkey % 4 = 1 then 'Asa Oberg' else c_name end as name from customer")
def reviewed_names(spark, sf):  # ENT-03
    k = F.col("c_custkey") % 4
    people = table(spark, sf, "customer").select("c_custkey", F.when(k == 1, "M").otherwise("S").alias("party"), F.when(k < 2, "Asa Oberg").otherwise(F.col("c_name")).alias("name"))
    aliases = spark.createDataFrame([("S", "asa-oberg", "Åsa Öberg"), ("V", "Asa Oberg", "Nobody")], "party string, alias string, canonical string")
    return entities.reviewed(people, aliases, "party", "name").select("c_custkey", "name")


@query("alias_pairs", f"with {PEOPLE}, p as (select distinct party, name from people) select p.party, p.name as a, q.name as b from p join p q on p.party = q.party and p.name < q.name and abs(length(p.name) - length(q.name)) <= 1 and damerau_levenshtein(p.name, q.name) <= 2 and levenshtein(replace(p.name, 'é', '~'), replace(q.name, 'é', '~')) <= 1")
def alias_pairs(spark, sf):  # ENT-02, JOIN-19
    return entities.alias_pairs(people(spark, sf), "party", "name")


@query("alias_canonical", f"""with {PEOPLE}, c as (select party, name, count(*) as n, length(regexp_replace(name, '[\\x00-\\x7F]', '', 'g')) as m, length(name) - length(replace(name, '-', '')) as h from people group by 1, 2),
 p as (select p.party, p.name as a, q.name as b, (p.n, p.m, p.h, length(p.name)) >= (q.n, q.m, q.h, length(q.name)) as aw from c p join c q on p.party = q.party and p.name < q.name and levenshtein(replace(p.name, 'é', '~'), replace(q.name, 'é', '~')) <= 1),
 w as (select party, a, b, case when aw then b else a end as alias, case when aw then a else b end as canonical from p)
 select party, alias, arg_max(canonical, {{'a': a, 'b': b}}) as canonical from w group by 1, 2""")
def alias_canonical(spark, sf):  # ENT-02, ENT-03, WIN-05
    return entities.automatic_aliases(people(spark, sf).withColumn("n", F.lit(1)), "party", "name", "n")


@query("person_index", f"""with {PEOPLE}, w as (select distinct party, body, name, string_split(name, ' ')[-1] as surname from people), m as (select party, surname, count(distinct name) as m, min(name) as wide from w group by 1, 2),
 n as (select party, body, surname, count(distinct name) as n, min(name) as near from w group by 1, 2, 3)
 select party, body, surname, case when n = 1 then near when m = 1 then wide end as name from n join m using (party, surname) where n = 1 or m = 1""")
def person_index(spark, sf):  # ENT-04
    return entities.person_index(people(spark, sf), "party", "body", "name")


MEMBERS = """m as (select p_type as party, p_brand as body, case when p_partkey % 3 = 0 then '' else ['Anna', 'Bo', 'Åsa Maria', 'Eva-Lena', 'Ordförande Anna'][1 + p_partkey % 5] || ' ' end || case when p_partkey % 7 = 0 then 'Ék' else 'Ek' end || (p_partkey % 31)::varchar as raw from part),
 i as (select distinct party, body, name, norm, split_part(norm, ' ', 1) as first, split_part(norm, ' ', -1) as last, case when contains(norm, ' ') then split_part(norm, ' ', 1) || '|' || split_part(norm, ' ', -1) end as identity
   from (select *, regexp_replace(raw, '^Ordförande ', '') as name, replace(strip_accents(lower(regexp_replace(raw, '^Ordförande ', ''))), '-', ' ') as norm from m)),
 sp as (select party, identity, arg_min(name, row(-length(name), norm, name)) as spelt from i where identity is not null group by 1, 2),
 ne as (select party, body, last, count(distinct identity) as n, min(identity) as near from i where identity is not null group by 1, 2, 3), wi as (select party, last, count(distinct identity) as m, min(identity) as wide from i where identity is not null group by 1, 2),
 h as (select i.*, case when identity is not null then 'identity' when n = 1 then 'body' when n is null and m = 1 then 'party' else 'own' end as how, near, wide from i left join ne using (party, body, last) left join wi using (party, last)),
 f as (select h.party, h.body, h.norm, coalesce(spelt, h.name) as name, how from h left join sp on sp.party = h.party and sp.identity = case how when 'identity' then h.identity when 'body' then near when 'party' then wide end)"""


def members(spark, sf):
    k = F.col("p_partkey")
    first = F.get(F.array(*[F.lit(x) for x in ("Anna", "Bo", "Åsa Maria", "Eva-Lena", "Ordförande Anna")]), (k % 5).cast("int"))
    name = F.concat(F.when(k % 3 == 0, "").otherwise(F.concat(first, F.lit(" "))), F.when(k % 7 == 0, "Ék").otherwise("Ek"), (k % 31).cast("string"))
    return table(spark, sf, "part").select(F.col("p_type").alias("party"), F.col("p_brand").alias("body"), name.alias("raw"))


@query("people_by_body", f"with {MEMBERS} select party, body, norm, min(name) as name, min(how) as how from f group by 1, 2, 3")
def people_by_body(spark, sf):  # ENT-04
    return entities.resolved_people(members(spark, sf), "party", "body", "raw")[0]


@query("people_by_party", f"with {MEMBERS} select party, norm, case when min(name) = max(name) then min(name) else '' end as name from f group by 1, 2")
def people_by_party(spark, sf):  # ENT-04: blank where bodies disagree
    return entities.resolved_people(members(spark, sf), "party", "body", "raw")[1]


REFS = """refs as (select id, row_number() over (partition by id order by place) - 1 as pos, label, case when label[1] = '§' then 'section' when regexp_matches(label, '^20[0-9]{2}-[0-9]{2}-[0-9]{2}$') then 'date' when contains(label, '/') then 'diary' else 'day' end as kind
 from (select p_partkey as id, unnest(range(6)) as place, unnest(['§ ' || p_size::varchar || case when p_partkey % 3 = 0 then '.' || (p_partkey % 4)::varchar else '' end, case when p_partkey % 4 > 1 then 'Ks ' || p_partkey::varchar || '/2024' end,
   case when p_partkey % 5 > 0 then '2024-01-' || lpad((1 + p_partkey % 28)::varchar, 2, '0') end, case when p_partkey % 2 = 0 then '3 Mars 2024' else '13 maj' end, case when p_partkey % 7 = 0 then 'KsSn 12/2023' end, case when p_partkey % 6 = 0 then '§12' end]) as label from part) where label is not null)"""


def references_text(spark, sf):
    """Labels, and what looks like one but is none: after a letter or digit, in small letters, or of another century."""
    p, k, lit = joins.spread(table(spark, sf, "part"), "p_partkey"), F.col("p_partkey"), F.lit
    said = F.concat(
        lit("Enligt § "), F.col("p_size").cast("string"), F.when(k % 3 == 0, F.concat(lit("."), (k % 4).cast("string"))).otherwise(""), lit(", se "), F.when(k % 4 == 0, "ks ").when(k % 4 == 1, "1xKs ").otherwise("Ks "), k.cast("string"), lit("/2024 av den "),
        F.when(k % 5 == 0, "1").otherwise(""), lit("2024-01-"), F.lpad((1 + k % 28).cast("string"), 2, "0"), lit(" och 1999-01-02, "), F.when(k % 2 == 0, "3 Mars 2024").otherwise("13 maj"), lit(". "), F.when(k % 7 == 0, "KsSn 12/2023").otherwise("Ks 12/1923"),
        lit(" samt "), F.when(k % 6 == 0, "§12").otherwise("12 marsipaner"),
    )
    return p.select(k.alias("id"), said.alias("text"))


@query("ref_extract", f"with {REFS} select id, cast(pos as integer) as pos, label, kind from refs")
def ref_extract(spark, sf):  # REF-01, REF-02
    return references.extract(references_text(spark, sf), "id", "text")


DATED = """said as (select p_partkey as k, case when p_partkey % 9 = 0 then null else (2010 + p_partkey % 13)::varchar || '-05-06' end as own,
  case when p_partkey % 3 = 0 then 'Budget 20' || lpad((p_partkey % 30)::varchar, 2, '0') || ', ' else 'Sedan ' end || repeat('x ', (p_partkey % 80)::integer) || 'den 3 mars och § 4.2 samt 12 Maj ' || repeat('y ', (1 + p_partkey % 100)::integer) || case when p_partkey % 4 = 0 then '2021' when p_partkey % 4 = 1 then 'a2022b 2023' else '' end || ' till 1 juni 2020, Ks 7/2019.' as text from part),
 l as (select *, strpos(text, '3 mars') as a, strpos(text, '12 Maj') as b, strpos(text, '1 juni 2020') as c from said),
 e as (select k, own, text, unnest([a, strpos(text, '§ 4.2'), b, c, strpos(text, 'Ks 7/2019')]) as s0, unnest(['3 mars', '§ 4.2', '12 Maj', '1 juni 2020', 'Ks 7/2019']) as label, unnest(range(5)) as pos, unnest(['day', 'section', 'day', 'day', 'diary']) as kind, unnest(['03-03', '', '05-12', '06-01', '']) as md from l),
 y as (select *, regexp_extract(substr(text, s0, 160), '\\b(20[0-9]{2})\\b', 1) as ahead, regexp_extract_all(substr(text, greatest(s0 - 120, 1), s0 - greatest(s0 - 120, 1)), '\\b(20[0-9]{2})\\b', 1)[-1] as behind from e),
 d as (select *, coalesce(nullif(ahead, ''), behind, own[1:4]) as year from y)"""


@query("ref_years", f"with {DATED} select k as p_partkey, pos::integer as pos, label, kind, case when kind = 'day' and label <> '1 juni 2020' then concat_ws(' ', label, year) else label end as full, case when kind = 'day' then case when label = '1 juni 2020' then '2020-06-01' else year || '-' || md end end as iso from d")
def ref_years(spark, sf):  # REF-01: years of days that have none
    return references.extract_dated(dated_text(spark, sf), "p_partkey", "text", "own")


@query("ref_day_targets", f"""with {DATED}, r as (select distinct k, year || '-' || md as iso from d where kind = 'day' and label = '3 mars'), m as (select k, k % 40 as matter from said),
 rows as (select k as id, (2010 + k % 13)::varchar || '-03-03' as date, k % 40 as matter from said)
 select r.k as p_partkey, min(rows.id) as target from r join m using (k) join rows on rows.date = r.iso and rows.matter = m.matter and rows.id <> r.k group by 1""")
def ref_day_targets(spark, sf):  # REF-01, REF-05: days find rows of their matter once they have a year
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    said = dated_text(spark, sf)
    rows = said.select(k.alias("id"), none.alias("doc"), F.concat((2010 + k % 13).cast("string"), F.lit("-03-03")).alias("date"), F.lit("b").alias("body"), (k % 40).cast("string").alias("matter"), none.alias("diary"), F.lit("1").alias("point"))
    found = references.as_targets(references.extract_dated(said, "p_partkey", "text", "own").where("label = '3 mars'"))
    refs = found.join(rows.withColumnRenamed("id", "p_partkey"), "p_partkey").select(k.alias("ref"), "kind", "label", k.alias("id"), "doc", "date", "body", "matter", "diary", "point", none.alias("url"))
    made = references.targets(refs, rows.withColumn("base", none), rows.select("id", "date", "body").limit(0))
    return made.where("target is not null").select(F.col("ref").alias("p_partkey"), "target")


def dated_text(spark, sf):
    k = F.col("p_partkey")
    lead = F.when(k % 3 == 0, F.concat(F.lit("Budget 20"), F.lpad((k % 30).cast("string"), 2, "0"), F.lit(", "))).otherwise("Sedan ")
    late = F.when(k % 4 == 0, "2021").when(k % 4 == 1, "a2022b 2023").otherwise("")
    said = F.concat(lead, F.repeat(F.lit("x "), (k % 80).cast("int")), F.lit("den 3 mars och § 4.2 samt 12 Maj "), F.repeat(F.lit("y "), (1 + k % 100).cast("int")), late, F.lit(" till 1 juni 2020, Ks 7/2019."))
    return joins.spread(table(spark, sf, "part"), "p_partkey").select(k, F.when(k % 9 > 0, F.concat((2010 + k % 13).cast("string"), F.lit("-05-06"))).alias("own"), said.alias("text"))


REF_ROWS = """rows as (select o_orderkey as id, 'D' || (o_orderkey // 8)::varchar as doc, cast(o_orderdate as date)::varchar as date, n_name as body, case when o_orderkey % 11 > 0 then (o_custkey % 400)::varchar end as matter,
  case when o_orderkey % 5 > 0 then 'ks ' || (o_orderkey % 900)::varchar || '/2024' end as diary, (o_orderkey % 60)::varchar as base, (o_orderkey % 60)::varchar || '.' || (o_orderkey % 3)::varchar as point,
  case when o_orderkey % 4 > 0 then 'u' end as url from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
 refs as (select id * 3 + k as ref, ['section', 'diary', 'date'][k + 1] as kind, case k when 0 then (id * 7 % 63)::varchar when 1 then case when id % 13 = 0 then coalesce(diary, 'ks 1/2024') else 'ks ' || (id * 3 % 1100)::varchar || '/2024' end
   else case when id % 2 = 0 then date else lag(date) over (partition by matter, k order by id) end end as label, id, doc, date, body, matter, diary, point, url from rows, range(3) r(k))"""


@query("ref_target_tiers", f"""with {REF_ROWS}, m as (select date, body, min(id) as id from rows where id % 10 = 0 group by 1, 2),
 asked as (select ref, kind, label, id, doc, date, body, matter, diary, point from refs where kind <> 'date' and not (kind = 'diary' and diary is not distinct from label)),
 c as (select a.ref, a.kind, struct_pack(id := a.id, doc := a.doc, date := a.date, body := a.body, matter := a.matter, diary := a.diary, point := a.point) as a, struct_pack(id := t.id, doc := t.doc, date := t.date, body := t.body, matter := t.matter, diary := t.diary, point := t.point) as t from asked a join rows t on t.base = a.label where a.kind = 'section'
   union all select a.ref, a.kind, struct_pack(id := a.id, doc := a.doc, date := a.date, body := a.body, matter := a.matter, diary := a.diary, point := a.point), struct_pack(id := t.id, doc := t.doc, date := t.date, body := t.body, matter := t.matter, diary := t.diary, point := t.point) from asked a join rows t on t.diary = a.label where a.kind = 'diary'),
 j as (select ref, t.id as target, case when t.doc = a.doc then 0 when t.date = a.date and t.body = a.body then 1 when t.body = a.body and kind = 'section' then 2 else 3 end as pool,
   case when t.id = a.id and t.point = a.point then 0 when t.diary = a.diary and t.doc = a.doc then 1 when t.diary = a.diary and t.date = a.date and t.body = a.body then 2 when t.diary = a.diary then 3
     when t.id <> a.id and t.matter = a.matter and t.date >= a.date then 4 when t.id <> a.id and t.matter = a.matter then 5 when t.id <> a.id and t.doc = a.doc then 6 when t.id <> a.id then 7 else 8 end as rank, t.date, t.point
   from c),
 best as (select ref, target, ['document', 'meeting', 'body', 'all'][pool + 1] as pool from j qualify row_number() over (partition by ref order by pool, case when pool > 1 and rank in (1, 2) then 3 else rank end, case when rank in (4, 5) then date end, case when rank in (4, 5, 6) then point end, target) = 1),
 day as (select ref, coalesce(case when m.id <> r.id then m.id end, (select min(t.id) from rows t where t.date = r.label and t.matter = r.matter and t.id <> r.id)) as target, case when m.id <> r.id then 'meeting' else 'matter' end as pool
   from refs r left join m on r.label = m.date and r.body = m.body and r.date = r.label where kind = 'date'),
 f as (select * from best union all select ref, id, 'own' from refs where kind = 'diary' and diary = label union all select * from day where target is not null)
 select r.ref, r.kind, case when f.target <> r.id then f.target end as target, case when f.target <> r.id then f.pool when r.kind <> 'date' and url is not null then 'source' else 'none' end as pool from refs r left join f using (ref)""")
def ref_target_tiers(spark, sf):  # REF-02 to REF-06, JOIN-17
    k = F.col("id")
    text_of = lambda c: c.cast("string")
    p = points(spark, sf).select("id", text_of(F.col("date")).alias("date"), "body", F.col("matter").alias("m"))
    rows = p.select(
        "id", F.concat(F.lit("D"), text_of(F.floor(k / 8))).alias("doc"), "date", "body", F.when(k % 11 > 0, text_of(F.col("m") % 400)).alias("matter"),
        F.when(k % 5 > 0, F.concat(F.lit("ks "), text_of(k % 900), F.lit("/2024"))).alias("diary"), text_of(k % 60).alias("base"), F.concat(text_of(k % 60), F.lit("."), text_of(k % 3)).alias("point"), F.when(k % 4 > 0, "u").alias("url"),
    )
    day = F.when(k % 2 == 0, F.col("date")).otherwise(F.lag("date").over(W.partitionBy("matter").orderBy("id")))
    diary = F.when(k % 13 == 0, F.coalesce("diary", F.lit("ks 1/2024"))).otherwise(F.concat(F.lit("ks "), text_of(k * 3 % 1100), F.lit("/2024")))
    said = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(n).alias("kind"), c.alias("label")) for i, (n, c) in enumerate((("section", text_of(k * 7 % 63)), ("diary", diary), ("date", day)))])
    refs = rows.withColumn("x", said).select(F.explode("x").alias("x"), *[c for c in rows.columns if c != "base"]).select((k * 3 + F.col("x.k")).alias("ref"), "x.kind", "x.label", *[c for c in rows.columns if c != "base"])
    return references.targets(refs, rows.drop("url"), rows.where("id % 10 = 0").select("id", "date", "body"))


@query("ref_dates", "with e as (select event_id, user_id, cast(ts as date) as day, event_type from events) select a.event_id as own, a.day::varchar as day, min(b.event_id) as target, a.user_id from e a join e b on a.user_id = b.user_id and a.day = b.day and a.event_id <> b.event_id where a.event_type = 'view' and b.event_type = 'click' group by 1, 2, 4")
def ref_dates(spark, sf):  # REF-05
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("date").alias("day"), "event_type")
    refs = e.where("event_type = 'view'").select(F.col("event_id").alias("own"), "user_id", "day")
    rows = e.where("event_type = 'click'").select("user_id", "day", F.col("event_id").alias("target"))
    return references.date_target(refs, rows, "day", "user_id", "own", "target").withColumn("day", F.col("day").cast("string"))
