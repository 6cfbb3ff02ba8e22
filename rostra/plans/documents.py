"""Extraction from texts and pages (PRS, WIN-06 to 08, SRC)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostra.operators import extraction, joins, windows
from rostra.plans.civic import query, table
from rostra.sources import listings, packs


def protocols(spark, sf):
    """A small protocol per part, over two pages. Which diary number, date, lists, headers, decisions and counts it has, and how
    they are written, follows from its number, so that each rule fires for some rows and not for others."""
    p, k = joins.spread(table(spark, sf, "part"), "p_partkey"), F.col("p_partkey")
    text, lit = lambda c: c.cast("string"), F.lit
    diary = F.when(k % 7 == 0, "").when(k % 7 == 1, F.concat(lit(" Ks "), text(k), lit("/2024, Ks "), text(k + 1), lit("/2024"))).otherwise(F.concat(lit(" Ks "), text(k), lit("/2024")))
    date = F.when(k % 6 == 0, "").otherwise(F.concat(lit("\nDatum: 2024-02-0"), text(1 + k % 9)))
    members = F.when(k % 4 == 0, "\nNärvarande\nAnna Berg (S)\nBo Ek (M)").when(k % 4 == 1, "\nBeslutande ledamöter:\nAnna Berg (S)\nutan parti").otherwise("\nBeslutande ledamöter\nAnna Berg (S)\nBo Ek (M)")
    others = F.when(k % 5 == 0, "").otherwise("\nErsättare\nCi Dahl (V)")
    one = F.concat(lit("Protokoll"), diary, date, members, others, lit("\nÖvriga\nEva Fors (X)\n1 (2)"))
    moves = F.when(k % 3 == 0, "Anna Berg (S) yrkar bifall till motionen. Anna Berg (S) yrkar bifall.").when(k % 3 == 1, "Anna Berg (S) yrkar bifall till motionen. Bo Ek (M) och Ci Dahl (V) yrkar avslag.").otherwise("Ingen yrkar.")
    decided = F.when(k % 2 == 0, F.concat(lit("Nämnden beslutar att\n1. godkänna "), F.col("p_brand"), lit("\n2. utse\nledamot"))).otherwise("Motionen bifalls\ni sin helhet.")
    vote = F.when(k % 5 == 0, "").when(k % 5 == 1, "\nOmröstning genomförs.").otherwise(F.concat(lit("\nOmröstning genomförs: Ja: "), text(k % 5), lit(", 3 nej-röster."), F.when(k % 4 == 0, " 2 avstår").otherwise("")))
    second = F.when(k % 8 == 0, F.concat(lit("\n§ "), text(F.col("p_size")), lit(" Val"))).when(k % 8 == 1, "\nenligt § 99 Val").otherwise("\n§ 99 Val")
    two = F.concat(lit("§ "), text(F.col("p_size")), lit(" Motion om "), F.col("p_name"), lit("\n"), moves, second, lit("\n"), decided, vote, lit("\n2 (2)"))
    return p.select("p_partkey", F.posexplode(F.array(one, two)).alias("n", "text"), decided.alias("decided")).select("p_partkey", (F.col("n") + 1).alias("page"), "text", "decided")


@query("first_page_fields", """select p_partkey, case when p_partkey % 7 in (0, 1) then '' else 'Ks ' || p_partkey::varchar || '/2024' end as diary, case when p_partkey % 6 = 0 then '' else '2024-02-0' || (1 + p_partkey % 9)::varchar end as date from part""")
def first_page_fields(spark, sf):  # PRS-01, PRS-02
    return protocols(spark, sf).where("page = 1").select("p_partkey", extraction.diary_from_first_page(F.col("text")).alias("diary"), extraction.first_page_date(F.col("text")).alias("date"))


@query("attendance_lists", """select p_partkey, name, party, role from part, (values ('Anna Berg', 'S', 'member'), ('Bo Ek', 'M', 'member'), ('Ci Dahl', 'V', 'substitute')) v(name, party, role)
 where case name when 'Anna Berg' then p_partkey % 4 > 0 when 'Bo Ek' then p_partkey % 4 > 1 else p_partkey % 5 > 0 end""")
def attendance_lists(spark, sf):  # PRS-03, WIN-07
    return extraction.attendance(protocols(spark, sf), ["p_partkey"], "page", "text", {"beslutande ledamöter": "member", "ersättare": "substitute"})


@query("sections", """with d as (select *, case when p_partkey % 2 = 0 then 4 else 2 end + case when p_partkey % 5 = 0 then 0 else 1 end + 1 as lines from part),
 s as (select p_partkey, p_size::varchar as section, 'Motion om ' || p_name as title, case when p_partkey % 8 = 1 then 2 + lines else 1 end as n_lines, p_partkey % 8 = 0 as again from d
  union all select p_partkey, case when p_partkey % 8 = 0 then p_size::varchar else '99' end, 'Val', lines, p_partkey % 8 = 0 or p_size = 99 from d where p_partkey % 8 <> 1)
 select p_partkey, section, title, cast(2 as integer) as first_page, cast(2 as integer) as last_page, n_lines::bigint as n_lines, again as repeated from s""")
def sections(spark, sf):  # PRS-04, WIN-06
    return extraction.sections(protocols(spark, sf), "p_partkey", "page", "text")


@query("decision_points", """select p_partkey, '99.1' as point, 'Nämnden beslutar att godkänna ' || p_brand as decision from part where p_partkey % 2 = 0 union all select p_partkey, '99.2', 'Nämnden beslutar att utse ledamot' from part where p_partkey % 2 = 0
 union all select p_partkey, '99', 'Motionen bifalls i sin helhet.' from part where p_partkey % 2 = 1""")
def decision_points(spark, sf):  # PRS-05, PRS-08, WIN-08
    decided = protocols(spark, sf).where("page = 2").select("p_partkey", F.lit("99").alias("s"), F.col("decided").alias("t"))
    return extraction.decision_points(decided, "p_partkey", "s", "t")


@query("positions", """select p_partkey, name, party, stance from part, (values ('Anna Berg', 'S', 'Bifallsyrkande'), ('Bo Ek', 'M', 'Avslagsyrkande'), ('Ci Dahl', 'V', 'Avslagsyrkande')) v(name, party, stance) where p_partkey % 3 = 1 or (p_partkey % 3 = 0 and name = 'Anna Berg')""")
def positions(spark, sf):  # PRS-09
    return extraction.positions(protocols(spark, sf).where("page = 2"), ["p_partkey"], "text").drop("proposal")


@query("vote_statements", """select p_partkey, p_partkey % 5 > 0 as held, cast(case when p_partkey % 5 > 1 then p_partkey % 5 end as integer) as yes, cast(case when p_partkey % 5 > 1 then 3 end as integer) as no, cast(case when p_partkey % 5 > 1 and p_partkey % 4 = 0 then 2 else -1 end as integer) as abstain from part""")
def vote_statements(spark, sf):  # PRS-10
    two = protocols(spark, sf).where("page = 2").select("p_partkey", "text", extraction.stated_tally(F.col("text")).alias("t"))
    return two.select("p_partkey", extraction.vote_held(F.col("text")).alias("held"), "t.yes", "t.no", F.coalesce("t.abstain", F.lit(-1)).alias("abstain"))


@query("repaired_meanings", """select p_partkey, case when p_partkey % 3 = 0 then left('JA-röst innebär bifall till ' || p_name || '.', 25) when p_partkey % 3 = 1 then 'JA-röst innebär bifall till ' || p_name || '.' else 'JA-rös' end as meaning from part""")
def repaired_meanings(spark, sf):  # PRS-15: found whole, not found, too short to look for
    k = F.col("p_partkey")
    full = F.concat(F.lit("JA-röst innebär bifall till "), "p_name", F.lit("."))
    source = F.when(k % 3 == 0, "Se nedan. NEJ-röst annat.").otherwise(F.concat(F.lit("Se nedan. "), full, F.lit(" NEJ-röst annat.")))
    cut = F.when(k % 3 == 2, F.substring(full, 1, 6)).otherwise(F.substring(full, 1, 25))
    return table(spark, sf, "part").select("p_partkey", extraction.repaired_meaning(cut, source).alias("meaning"))


@query("heading_carry_forward", "select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as heading from conversations qualify heading is not null")
def heading_carry_forward(spark, sf):  # WIN-07
    c = table(spark, sf, "conversations")
    return windows.carried_forward(c.select("conv_id", "turn", "role"), ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn"))).where("heading is not null").select("conv_id", "turn", "heading")


@query("turn_sections", "select conv_id, section, min(turn) as first, max(turn) as last, count(*) as n from (select conv_id, turn, count(*) filter (role = 'user') over (partition by conv_id order by turn rows unbounded preceding) as section from conversations) group by 1, 2")
def turn_sections(spark, sf):  # WIN-06
    return windows.sections(table(spark, sf, "conversations"), ["conv_id"], "turn", F.col("role") == "user")


@query("anchors", """with a as (select page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>([^<]*)</a>', 1)) as href, unnest(regexp_extract_all(html, '<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>([^<]*)</a>', 2)) as label from pages)
 select page_id, href, label, 'https://example.org' || href as link, count(*) as n from a group by all""")
def anchors(spark, sf):  # SRC-09, SRC-12
    found = listings.anchors(table(spark, sf, "pages"), "page_id", "html")
    return found.withColumn("link", listings.canonical_link(F.concat("href", F.lit("#top")), "https://example.org/")).groupBy("page_id", "href", "label", "link").agg(F.count("*").alias("n"))


TITLES = ("2024-02-03 Nämnden.pdf", "2024-02-03.pdf", "2024-02-03 Kallelse.pdf", "Kallelse och protokoll.PDF", "Protokoll 3.html", "Rapport.pdf", "2024-02-03 möte.pdf")
SECTIONS = ("Protokoll", "Budget", "", "Övrigt")


@query("protocol_pdfs", """with t as (select page_id, [%s][1 + page_id %% 7] as title, [%s][1 + page_id %% 4] as section from pages)
 select page_id, ends_with(lower(title), '.pdf') and (contains(lower(title || ' ' || section), 'protokoll') or (regexp_matches(title, '^20\\d{2}-\\d{2}-\\d{2}\\s')
   and not regexp_matches(lower(title || ' ' || section), 'ärendelista|arendelista|föredragningslista|kallelse|reglemente|arbetsordning|budget|rapport'))) as is_protocol from t""" % (", ".join(f"'{t}'" for t in TITLES), ", ".join(f"'{t}'" for t in SECTIONS)))
def protocol_pdfs(spark, sf):  # SRC-13
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("page_id") % len(values)).cast("int"))
    return table(spark, sf, "pages").select("page_id", listings.is_protocol_pdf(pick(TITLES), pick(SECTIONS)).alias("is_protocol"))


@query("preceding_headings", """with h as (select user_id, event_id as pos, event_type as label from events where event_type in ('signup', 'error')), i as (select user_id, event_id as pos from events where event_type = 'view')
 select user_id, pos, coalesce((select case when max(h.pos) >= i.pos - 300 then arg_max(h.label, h.pos) end from h where h.user_id = i.user_id and h.pos < i.pos), '') as label from i""")
def preceding_headings(spark, sf):  # SRC-14
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("pos"), F.col("event_type").alias("label"))
    return listings.preceding_heading(e.where("label = 'view'"), e.where("label in ('signup', 'error')"), "user_id", "pos", "label", 300).fillna("", ["label"])


@query("embedded_states", """select p_partkey, case p_partkey % 4 when 2 then '' else 'A ' || p_size::varchar || ' / B' end as label, p_name || '.pdf' as name, case p_partkey % 4 when 2 then '' else 'https://example.org/' || p_partkey::varchar end as url from part where p_partkey % 4 > 1
 union all select p_partkey, 'A ' || p_size::varchar, '} ' || p_brand, '' from part where p_partkey % 4 = 3""")
def embedded_states(spark, sf):  # SRC-10, SRC-11: no state, a broken one, files at the root, files in nested folders
    k, t = F.col("p_partkey"), lambda c: F.col(c).cast("string")
    rest, call = F.lit('"note":"a \\\\" } b"'), F.lit("<script>x.registerInitialState('c', ")
    flat = F.concat(F.lit('{"files":[{"name":"'), "p_name", F.lit('.pdf"}],'), rest, F.lit("}"))
    deep = F.concat(F.lit('{"folders":[{"name":"A '), t("p_size"), F.lit('","files":[{"name":"} '), "p_brand", F.lit('"}],"folders":[{"name":"B","files":[{"name":"'), "p_name", F.lit('.pdf","url":"https://example.org/'), t("p_partkey"), F.lit('"}]}]}],'), rest, F.lit("}"))
    page = F.when(k % 4 == 0, "<p>{}</p>").when(k % 4 == 1, F.concat(call, F.lit('{"files": nothing});'))).otherwise(F.concat(call, F.when(k % 4 == 2, flat).otherwise(deep), F.lit(");</script>")))
    state = listings.embedded_state("registerInitialState(")
    return listings.folder_files(table(spark, sf, "part").select("p_partkey", state(page).alias("s")), "p_partkey", "s")


@query("page_states", """select p_partkey, 'c1' as component, p_name as name from part where p_partkey % 5 > 0 union all select p_partkey, 'c ' || p_size::varchar, p_brand || ' } `' from part where p_partkey % 7 > 0""")
def page_states(spark, sf):  # SRC-10: every state of a page; what is broken is left out
    k, name = F.col("p_partkey"), lambda v: F.concat(F.lit('{"a":{"name":"'), v, F.lit('"}}'))
    page = F.concat(
        F.lit("<script>AppRegistry.registerInitialState('c1', "), F.when(k % 5 == 0, '{"a":{"name":"x"}').otherwise(name(F.col("p_name"))), F.lit(");</script><script>AppRegistry.registerInitialState( \"c "), F.col("p_size").cast("string"), F.lit('" , '),
        F.when(k % 7 == 0, '{"a": nothing}').otherwise(name(F.concat("p_brand", F.lit(" } `")))), F.lit(");</script><p>{}</p>"),
    )
    found = listings.page_states(table(spark, sf, "part").select(k, page.alias("html")), "p_partkey", "html")
    return found.select("p_partkey", "component", F.get_json_object("state", "$.a.name").alias("name"))


@query("stride_unpack", "select o_custkey as pack, row_number() over (partition by o_custkey order by o_orderkey) - 1 as ord, o_orderkey::varchar as doc_index, o_orderstatus as point, 'n' as name, 'p' as party, 'Ja' as vote, o_orderkey::varchar || ':1' as participant_id from orders")
def stride_unpack(spark, sf):  # SRC-03
    key = F.col("o_orderkey").cast("string")
    six = F.array(key, F.col("o_orderstatus"), F.lit("n"), F.lit("p"), F.lit("Ja"), F.concat(key, F.lit(":1")))
    packed = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("pack")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", six.alias("a")))), lambda x: x["a"])).alias("r"))
    return packs.unstrided(packed, ["pack"], F.col("r")).withColumn("ord", F.col("ord").cast("bigint"))


@query("dictionary_decode", "select p_partkey::varchar as id, case p_partkey % 6 when 0 then 'a' when 1 then p_brand when 2 then 'c' || (p_partkey % 5)::varchar end as kind from part")
def dictionary_decode(spark, sf):  # SRC-04, SRC-07; places beyond the dictionary, and what is no place, mean nothing
    k = F.col("p_partkey")
    place = F.when(k % 6 == 3, "3").when(k % 6 == 4, "x").when(k % 6 == 5, F.lit(None)).otherwise((k % 6).cast("string"))
    strings = F.array(F.lit("a"), F.col("p_brand"), F.concat(F.lit("c"), (k % 5).cast("string")))
    return packs.decoded_dictionary(table(spark, sf, "part").select(F.array(k.cast("string"), place).alias("r"), strings.alias("s")), "r", "s", ["id", "kind"], ["kind"])
