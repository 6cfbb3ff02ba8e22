"""Records of protocols: sections' fields, decisions, votes, and the issues found on the way (PRS-05, 10, 12, 16 to 18, 21)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostra.functions.keys import ignorable_line, matter_type, result_class, slug, squeezed, text_or_empty
from rostra.functions.text import fold
from rostra.operators.extraction import PERSON, attendance, diary_from_first_page, first_page_date, stated_tally, vote_held
from rostra.sources.sinks import materialized

#: Headings of a section's fields: description, requests, procedure, vote, decision. Fixed values.
FIELD_HEADINGS = {
    "ärendebeskrivning": "ad", "sammanfattning": "ad", "bakgrund": "ad", "yrkande": "yd", "yrkanden": "yd", "proposition": "pd", "propositionsordning": "pd",
    "beslutsgång": "pd", "omröstning": "vd", "votering": "vd", "beslut": "bd", "nämndens beslut": "bd", "kommunfullmäktiges beslut": "bd", "kommunstyrelsens beslut": "bd",
}
#: Beginnings of headings of the description. Fixed values.
DESCRIPTION_STARTS = ("ärendebeskrivning", "sammanfattning av ärendet", "bakgrund och sammanfattning")
#: Headings that end a field without beginning one. Fixed values.
OTHER_HEADINGS = (
    "beslutsunderlag", "förslag till beslut", "förvaltningens förslag till beslut", "reservation", "reservationer", "särskilt yttrande", "protokollsanteckning",
    "jäv", "skickas till", "expedieras till", "upplysningar",
)
FIELDS = ("ad", "yd", "pd", "vd", "bd")
#: Roles by heading of an attendance list. Fixed values.
ATTENDANCE_HEADINGS = {"närvarande ledamöter": "ledamot", "tjänstgörande ersättare": "tjänstgörande ersättare", "närvarande ersättare": "ersättare"}
#: Longest line that still belongs to a title.
TITLE_LINE = 160
NAMED_VOTE = rf"(?iu)^\s*{PERSON}\s+(ja|nej|avstår|frånvarande)\s*$"
TALLY = (("yes", "Ja"), ("no", "Nej"), ("abstain", "Avstår"), ("absent", "Frånvarande"))


def section_lines(pages: DataFrame, doc: str, page: str, text: str, start: str = r"^§ *([0-9]+)(.*)$") -> DataFrame:
    """(doc, s, page, n, line, section, head): lines from the first section header on; ``section`` and ``head`` stand on headers."""
    rows = pages.select(doc, F.col(page).alias("page"), F.posexplode(F.split(text_or_empty(F.col(text)), "\n")).alias("n", "line"))
    header = F.col("line").rlike(start)
    order = W.partitionBy(doc).orderBy("page", "n").rowsBetween(W.unboundedPreceding, 0)
    held = rows.withColumn("s", F.sum(header.cast("int")).over(order)).where("s > 0")
    return held.select(doc, "s", "page", "n", "line", F.when(header, F.regexp_extract("line", start, 1)).alias("section"), F.when(header, squeezed(F.regexp_extract("line", start, 2))).alias("head"))


def heading_field(line: Column) -> Column:
    """The field that a heading begins, empty for other headings, null for lines that are none."""
    heading = F.regexp_replace(F.lower(line), ":+$", "")
    field = F.element_at(F.create_map(*[F.lit(x) for kv in FIELD_HEADINGS.items() for x in kv]), heading)
    described = F.lit(False)
    for x in DESCRIPTION_STARTS:
        described = described | heading.startswith(x)
    return F.coalesce(field, F.when(described, "ad"), F.when(heading.isin(*OTHER_HEADINGS), ""))


def section_fields(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, s, section, title, diary, ad, yd, pd, vd, bd, first_page, last_page, raw): a row for each section.

    Lines before any heading continue the title; a heading begins a field, which runs to the next heading; boilerplate is
    left out. ``raw`` holds all other lines. A section, as part of one document, is gathered by one task.
    """
    line = squeezed(F.col("line"))
    kept = lines.select("*", line.alias("l")).where(F.col("section").isNotNull() | ((F.col("l") != "") & ~ignorable_line(F.col("line"))))
    diary = F.nullif(F.regexp_extract("l", r"(?iu)^Ärendenummer:\s*(.+?)\s*$", 1), F.lit(""))
    mark = F.when(F.col("section").isNull(), F.when(diary.isNotNull() | F.col("l").rlike(r"(?iu)^Handläggare:"), "").otherwise(heading_field(F.col("l"))))
    order = W.partitionBy(doc, "s").orderBy("page", "n").rowsBetween(W.unboundedPreceding, 0)
    rows = kept.withColumn("diary", F.when(F.col("section").isNull(), diary)).withColumn("mark", mark).withColumn("active", F.last("mark", ignorenulls=True).over(order))
    part = (
        F.when(F.col("section").isNotNull(), "head").when(F.col("mark").isNotNull(), "mark")
        .when(F.col("active").isNull(), F.when(F.length("l") <= TITLE_LINE, "title")).when(F.col("active") != "", F.col("active"))
    )
    pieces = F.sort_array(F.collect_list(F.struct("page", "n", part.alias("part"), "l")))
    made = rows.groupBy(doc, "s").agg(
        F.max("section").alias("section"), F.max("head").alias("head"), F.max_by("diary", F.when(F.col("diary").isNotNull(), F.struct("page", "n"))).alias("diary"),
        F.min("page").alias("first_page"), F.max("page").alias("last_page"), pieces.alias("x"),
    )
    of = lambda name: F.transform(F.filter("x", lambda p: F.coalesce(p["part"], F.lit("")) == name), lambda p: p["l"])
    return made.select(
        doc, "s", "section", F.trim(F.concat_ws(" ", F.col("head"), F.array_join(of("title"), " "))).alias("title"), F.coalesce("diary", F.lit("")).alias("diary"),
        *[F.array_join(of(f), "\n").alias(f) for f in FIELDS], "first_page", "last_page", F.transform(F.filter("x", lambda p: F.coalesce(p["part"], F.lit("")) != "head"), lambda p: p["l"]).alias("raw"),
    )


def roll_call(raw: Column) -> Column:
    """Array of (name, party, vote) from lines ``name (party) vote``."""
    hits = F.filter(raw, lambda x: x.rlike(NAMED_VOTE))
    return F.transform(hits, lambda x: F.struct(F.regexp_extract(x, NAMED_VOTE, 1).alias("name"), F.regexp_extract(x, NAMED_VOTE, 2).alias("party"), F.initcap(F.regexp_extract(x, NAMED_VOTE, 3)).alias("vote")))


def with_votes(sections: DataFrame, points: Column) -> DataFrame:
    """Adds ``held``, ``stated`` (struct of counts), ``named`` (roll call) and ``vote_issues`` to sections; ``points`` is the number of decisions.

    Issues: neither names nor counts, counts without names, several decisions, more than two mentions of a vote, names that
    contradict the counts.
    """
    said = F.concat_ws("\n", "pd", "vd")
    rows = sections.withColumn("held", vote_held(said)).withColumn("stated", stated_tally(said)).withColumn("named", F.when(F.col("held"), roll_call(F.col("raw"))).otherwise(roll_call(F.array().cast("array<string>"))))
    counted, n = F.coalesce(*[F.col(f"stated.{c}") for c, _ in TALLY]).isNotNull(), F.size("named")
    mentions = F.regexp_count(F.lower(said), F.lit(r"(?<![\p{L}\p{N}_])(omröstning|votering)(?![\p{L}\p{N}_])"))
    conflict = F.lit(False)
    for c, word in TALLY:
        conflict = conflict | F.coalesce(F.col(f"stated.{c}") != F.size(F.filter("named", _votes(word))), F.lit(False))
    found = F.array_compact(F.array(
        F.when((n == 0) & ~counted, "vote_not_resolved").when(n == 0, "named_vote_list_not_extracted"), F.when(points > 1, "vote_point_mapping_ambiguous"),
        F.when(mentions > 2, "multiple_vote_events_possible"), F.when((n > 0) & conflict, "vote_tally_conflict"),
    ))
    return rows.withColumn("vote_issues", F.when(F.col("held"), found).otherwise(F.array().cast("array<string>")))


def _votes(word: str):
    return lambda x: x["vote"] == word


def numbered_decisions(text: Column) -> Column:
    """Array of a decision's numbered lines; empty where there is none."""
    return F.filter(F.split(text_or_empty(text), "\n"), lambda x: x.rlike(r"^\s*[0-9]+\.\s*"))


def protocol_records(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """``section_fields`` with votes, classes and the number of decisions: a record for each section of each protocol."""
    sections = section_fields(section_lines(pages, doc, page, text), doc)
    n = F.greatest(F.lit(1), F.size(numbered_decisions(F.col("bd"))))
    rows = with_votes(sections.withColumn("n_points", n), F.col("n_points"))
    result = result_class(F.col("bd"))
    return rows.withColumn("matter_type", matter_type(F.col("title"), F.col("ad"))).withColumn("result", result["result"]).withColumn("outcome", result["outcome"]).withColumn("confidence", result["confidence"])


def protocol_issues(pages: DataFrame, known: DataFrame, records: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, section, code, severity) of protocols against what is known of them: (doc, date, diary, body).

    Of the first page: date, diary number and body; of the protocol: sections, repeated numbers and attendance; of its
    sections: ``vote_issues``. ``section`` is empty for issues of the protocol.
    """
    records = materialized(records.select(doc, "section", "vote_issues"))  # asked three times, parsed once
    first = pages.where(F.col(page) == 1).select(doc, text_or_empty(F.col(text)).alias("said"))
    seen = known.join(first, doc).select(doc, "date", "diary", "body", "said", first_page_date(F.col("said")).alias("d"), diary_from_first_page(F.col("said")).alias("n"))
    own = F.array_compact(F.array(
        F.when((F.coalesce("date", F.lit("")) == "") | (F.col("d") != F.col("date")), "date_mismatch"),
        F.when(F.col("n") == "", "protocol_diary_missing").when((F.coalesce("diary", F.lit("")) != "") & (F.lower("n") != F.lower("diary")), "protocol_diary_mismatch"),
        F.when(~F.contains(slug(F.col("said"), "_"), slug(F.col("body"), "_")), "body_mismatch"),
    ))
    whole = lambda df, code, severity="review": df.select(doc, F.lit("").alias("section"), F.lit(code).alias("code"), F.lit(severity).alias("severity"))
    of_page = seen.select(doc, F.lit("").alias("section"), F.explode(own).alias("code"), F.lit("review").alias("severity"))
    lost = known.join(records.select(doc).distinct(), doc, "left_anti")
    twice = records.groupBy(doc, "section").agg(F.count("*").alias("c")).where("c > 1").select(doc).distinct()
    absent = known.join(attendance(pages, [doc], page, text, ATTENDANCE_HEADINGS).select(doc).distinct(), doc, "left_anti")
    of_votes = records.select(doc, "section", F.explode("vote_issues").alias("code"), F.lit("review").alias("severity"))
    return of_page.unionByName(whole(lost, "sections_not_found", "error")).unionByName(whole(twice, "duplicate_sections")).unionByName(whole(absent, "attendance_not_extracted")).unionByName(of_votes)


def inferred_votes(text: Column) -> Column:
    """(yes, no, accepted, named): votes named in running text as ``Ja: people. Nej: people.``; accepted only if their numbers equal the stated counts."""
    lists = {w: F.regexp_extract(text_or_empty(text), rf"(?u)(?:^|[^\p{{L}}]){w}(?:-röst(?:er)?)?\s*:\s*([^.:0-9]*\([^.:]*)", 1) for w in ("Ja", "Nej")}
    people = lambda w: F.transform(
        F.arrays_zip(F.regexp_extract_all(lists[w], F.lit(PERSON), F.lit(1)).alias("n"), F.regexp_extract_all(lists[w], F.lit(PERSON), F.lit(2)).alias("p")),
        lambda x: F.struct(x["n"].alias("name"), x["p"].alias("party"), F.lit(w).alias("vote")),
    )
    stated = stated_tally(text)
    right = F.coalesce((F.size(people("Ja")) == stated["yes"]) & (F.size(people("Nej")) == stated["no"]), F.lit(False))
    return F.struct(stated["yes"].alias("yes"), stated["no"].alias("no"), right.alias("accepted"), F.when(right, F.concat(people("Ja"), people("Nej"))).otherwise(F.slice(people("Ja"), 1, 0)).alias("named"))


#: Words that end a numbered line of a decision. Fixed values.
AFTER_LINE = ("Medel", "Tillägget", "Jäv", "Reservation")


def final_line(decision: Column, point: Column) -> Column:
    """The text of the numbered line that a point (``section.number``) means, up to the next number or heading; else empty."""
    number = F.when(F.contains(point, F.lit(".")), F.substring_index(point, ".", -1))
    lines = F.split(F.replace(text_or_empty(decision), F.lit("\r"), F.lit("")), "\n")
    begins = F.transform(lines, lambda x: F.regexp_extract(x, r"^\s*([0-9]+)\.", 1) == number)
    at = F.array_position(begins, F.lit(True)).cast("int")
    rest = F.slice(lines, at + 1, F.size(lines))
    ends = F.array_position(F.transform(rest, lambda x: x.rlike(rf"(?iu)^\s*[0-9]+\.\s+|^\s*(?:{'|'.join(AFTER_LINE)})(?![\p{{L}}\p{{N}}_])")), F.lit(True)).cast("int")
    more = F.when(ends > 0, F.slice(rest, F.lit(1), ends - 1)).otherwise(rest)
    whole = F.array_join(F.concat(F.array(F.regexp_replace(F.get(lines, at - 1), r"^\s*[0-9]+\.\s*", "")), more), " ")
    return F.when(number.rlike("^[0-9]+$") & (at > 0), squeezed(whole)).otherwise("")


#: How running text tells of a vote: what opens it, which decision it is of, what the votes mean, who gave them, how many. Fixed patterns.
VOTE_MARKER = r"(?iu)votering\s+beg(?:ä|a)r(?:s|des)?\s+och\s+verkst(?:ä|a)ll(?:s|des)?\s*\.?"
VOTE_PHRASE = "votering begars och verkstalls"
VOTE_POINT = r"(?iu)beslutspunkt\s+([0-9]+)"
VOTE_MEANING = r"(?isu)Ja-r(?:ö|o)st\s+inneb(?:ä|a)r\s+(.+?)\.\s*Nej-?\s*r(?:ö|o)st\s+inneb(?:ä|a)r\s+(.+?)\.\s*(?=Ja-r(?:ö|o)ster|Nej-r(?:ö|o)ster|Ordf(?:ö|o)rande|resultatet)"
VOTE_NAMES = r"(?isu)Ja-r(?:ö|o)ster\s+l(?:ä|a)mnas\s+av\s+(.+?)\.\s*Nej-r(?:ö|o)ster\s+l(?:ä|a)mnas\s+av\s+(.+?)(?:\.|\nOrdf(?:ö|o)rande)"
VOTE_RESULT = r"(?iu)resultatet\s+([0-9]+)\s+ja-r(?:ö|o)ster\s+och\s+([0-9]+)\s+nej-r(?:ö|o)ster"
VOTE_PERSON = r"([^,;.]+?)\s*\(([A-Za-zÅÄÖåäö]+)\)"
#: Characters before a marker in which its decision is named.
LOOK_BACK = 2400


def _clean(said: Column) -> Column:
    return F.regexp_replace(squeezed(said), r"\s+-\s*", "-")


def _people(said: Column) -> Column:
    """Array of (name, party) of a list of people with parties in brackets."""
    text = _clean(said)
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(VOTE_PERSON), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(VOTE_PERSON), F.lit(2)).alias("p"))
    named = F.transform(pairs, lambda x: F.struct(F.regexp_replace(_clean(x["n"]), r"(?iu)^och\s+", "").alias("name"), x["p"].alias("party")))
    return F.filter(named, lambda x: x["name"] != "")


def paragraph_votes(docs: DataFrame, doc: str, name: str, text: str, points: str, voted: str) -> DataFrame:
    """(doc, point, event, yes_meaning, no_meaning, yes, no, yes_people, no_people): votes that running text tells of.

    ``points`` maps a document's points to texts, ``voted`` those that have events already; ``name`` names it in event ids.
    A marker opens a vote, which lasts to the next one. Its point is the last ``beslutspunkt N`` in the characters before it
    (the point of that number, the only point if there is but one). Accepted are votes with meanings, names and numbers, where
    as many are named as stated on either side, and none of them is nobody; events are numbered by their order in the text.
    A point that has an event, or got one before, gets none. Texts and maps that are null are empty.
    """
    said = text_or_empty(F.col(text))
    tells = F.contains(squeezed(fold(said)), F.lit(VOTE_PHRASE))
    parts = F.split(said, f"(?={VOTE_MARKER})")
    opened = docs.select(doc, F.col(name).alias("name"), F.coalesce(F.map_keys(points), F.array().cast("array<string>")).alias("known"), F.coalesce(F.map_keys(voted), F.array().cast("array<string>")).alias("has"), F.when(tells, parts).alias("parts"))
    # neither a filter nor one that follows from the exploded array: it would be worked out where the documents are read, by few tasks
    each = opened.select("*", F.posexplode_outer("parts").alias("i", "said")).where(F.col("said").rlike(f"^{VOTE_MARKER}"))
    before = F.array_join(F.slice("parts", F.lit(1), F.col("i")), "")
    number = F.try_element_at(F.regexp_extract_all(F.substr(before, F.greatest(F.length(before) - LOOK_BACK + 1, F.lit(1))), F.lit(VOTE_POINT), F.lit(1)), F.lit(-1))
    of_number = F.get(F.filter("known", lambda p: p.endswith(F.concat(F.lit("."), number)) | (p == number)), F.lit(0))
    in_base = F.concat(F.substring_index(F.get("known", F.lit(0)), ".", 1), F.lit("."), number)
    point = F.coalesce(F.when(F.array_contains("known", in_base), in_base), of_number, F.when(F.size("known") == 1, F.get("known", F.lit(0))))
    # exploded from one struct, so that each pattern is looked for once, however often its groups are asked
    cuts = F.array(F.struct(*[F.regexp_extract("said", p, i).alias(f"{c}{i}") for c, p in (("meaning", VOTE_MEANING), ("names", VOTE_NAMES), ("result", VOTE_RESULT)) for i in (1, 2)]))
    cut = lambda c, i: F.col(f"m.{c}{i}")
    meaning = lambda i: F.when(_clean(cut("meaning", i)).rlike(r"(?iu)^(?:bifall|avslag)(?![\p{L}\p{N}_])"), _clean(cut("meaning", i))).otherwise(F.concat(F.lit("bifall till "), _clean(cut("meaning", i))))
    count = lambda i: F.coalesce(cut("result", i).try_cast("int"), F.lit(0))
    rows = each.withColumn("point", point).where("point is not null and not array_contains(has, point)").select(doc, "name", "i", "point", F.explode(cuts).alias("m")).where(cut("meaning", 1) != "")
    rows = rows.select(doc, "name", "i", "point", meaning(1).alias("yes_meaning"), meaning(2).alias("no_meaning"), count(1).alias("yes"), count(2).alias("no"), _people(cut("names", 1)).alias("yes_people"), _people(cut("names", 2)).alias("no_people"))
    right = rows.where("yes > 0 and no > 0 and size(yes_people) = yes and size(no_people) = no")
    plain = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_]+", "_")
    nth = F.row_number().over(W.partitionBy(doc).orderBy("i"))
    event = F.concat(F.lit("vote_"), plain(F.col("name")), F.lit("_"), plain(F.col("point")), F.lit("_inferred_"), nth.cast("string"))
    first = F.row_number().over(W.partitionBy(doc, "point").orderBy("i"))
    numbered = right.withColumn("event", event).withColumn("first", first).where("first = 1")
    return numbered.select(doc, "point", "event", "yes_meaning", "no_meaning", "yes", "no", "yes_people", "no_people")


def paragraph_ballots(votes: DataFrame, doc: str) -> DataFrame:
    """(doc, point, event, name, party, vote, participant) of ``paragraph_votes``."""
    # both sides from one pass, as the votes before cost most
    sides = F.array(*[F.struct(F.lit(vote).alias("vote"), F.lit(side).alias("side"), F.col(f"{side}_people").alias("people")) for side, vote in (("yes", "Ja"), ("no", "Nej"))])
    each = votes.select(doc, "point", "event", F.explode(sides).alias("x")).select(doc, "point", "event", "x.*")
    every = each.select(doc, "point", "event", "vote", "side", F.posexplode("people").alias("n", "who"))
    return every.select(doc, "point", "event", "who.name", "who.party", "vote", F.concat_ws("", "event", F.lit(":"), "side", F.lit("_"), (F.col("n") + 1).cast("string")).alias("participant"))


def reconciled_result(result: Column, decision: Column, line: Column) -> Column:
    """The stated result set right by the point's own line: a rejection there rejects; a grant there, or an amount among two grants or more, approves what was taken for rejected."""
    word = lambda ws: rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{ws})(?![\p{{L}}\p{{N}}_])"
    rejects, grants = line.rlike(word("avslag|avslås|beviljas inte|utan bifall")), line.rlike(word("beviljas?|bifall|bevilja"))
    amount = line.rlike(r"(?iu)(?<![\p{L}\p{N}_])[0-9][0-9\s]*\s*(?:kr(?:onor)?|tkr)(?![\p{L}\p{N}_])")
    granted = F.size(F.filter(F.split(text_or_empty(decision), "\n"), lambda x: x.rlike(r"(?iu)^\s*[0-9]+\.\s+.*(?<![\p{L}\p{N}_])beviljas?(?![\p{L}\p{N}_])"))) >= 2
    return F.when(line == "", result).when((result == "reject") & (grants | (~rejects & amount & granted)), "approved").when((result != "reject") & rejects, "reject").otherwise(result)


def cover_body(text: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """The body of a protocol's cover page, by the first phrase that it holds; empty if the page is no cover (no date line, or neither people present nor time and place)."""
    clean = F.lower(squeezed(text_or_empty(text)))
    has = lambda w: F.contains(clean, F.lit(w))
    body = F.coalesce(*[F.when(has(p), F.lit(name)) for p, name in phrases], F.lit(""))
    return F.when((first_page_date(text) != "") & has("datum:") & (has("närvarande") | (has("tid:") & has("plats:"))), body).otherwise("")


def deduplicated_parts(parts: DataFrame, group: str) -> DataFrame:
    """(group, part, kept, overlaps) of a meeting's parts (group, part, pages, rank, signature, sections, declared).

    Best first (smallest section, more pages, rank, part), a part goes if its text, its sections or its declared sections
    are those of a kept one; a kept part that shares a number with an earlier kept one says which. The choice for one part
    depends on those before, so a meeting, which has few parts, is judged within its row: a fold over its parts in order.
    """
    none = F.array().cast("array<int>")
    rows = parts.select(group, "part", "pages", "rank", F.coalesce("signature", F.lit("")).alias("signature"), *[F.sort_array(F.array_distinct(F.coalesce(c, none))).alias(c) for c in ("sections", "declared")])
    said = lambda mark, c: F.when(F.size(c) > 0, F.concat(F.lit(mark), F.array_join(F.transform(c, lambda x: x.cast("string")), ",")))
    own = F.array_compact(F.array(F.when(F.col("signature") != "", F.concat(F.lit("t"), "signature")), said("s", "sections"), said("d", "declared")))
    rows = rows.select(group, "part", "pages", "rank", own.alias("own"), F.when(F.size("declared") > 0, F.col("declared")).otherwise(F.col("sections")).alias("number"))
    first = F.coalesce(F.array_min("number"), F.lit(1_000_000))
    held = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(first.alias("first"), F.negative("pages").alias("pages"), "rank", "part", "own", "number"))).alias("x"))
    kind = parts.schema["part"].dataType.simpleString()
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<array<int>>").alias("kept"), F.array().cast(f"array<struct<part:{kind},kept:boolean,overlaps:array<int>>>").alias("out"))

    def judged(state: Column, r: Column) -> Column:
        stays = ~F.arrays_overlap(state["seen"], r["own"])
        other = F.get(F.filter(state["kept"], lambda k: F.arrays_overlap(k, r["number"])), F.lit(0))
        shared = F.when(stays & other.isNotNull(), F.array_intersect(r["number"], other)).otherwise(none)
        return F.struct(
            F.when(stays, F.concat(state["seen"], r["own"])).otherwise(state["seen"]).alias("seen"), F.when(stays, F.concat(state["kept"], F.array(r["number"]))).otherwise(state["kept"]).alias("kept"),
            F.concat(state["out"], F.array(F.struct(r["part"].alias("part"), stays.alias("kept"), shared.alias("overlaps")))).alias("out"),
        )

    return held.select(group, F.inline(F.aggregate("x", start, judged, lambda s: s["out"])))


def meeting_groups(parts: DataFrame) -> DataFrame:
    """(body, date, diaries, missing, error) of parts (body, date, diary): a meeting with several diary numbers is ambiguous, and so
    is one where a part has none beside several; one without any number has none."""
    empty = F.coalesce("diary", F.lit("")) == ""
    n = F.count_distinct(F.when(~empty, F.lower("diary")))
    out = parts.groupBy("body", "date").agg(n.alias("diaries"), F.count_if(empty).alias("missing"))
    return out.withColumn("error", F.when((F.col("diaries") > 1) & (F.col("missing") > 0), "diary_missing_beside_several").when(F.col("diaries") > 1, "several_diaries").otherwise(""))


def point_rows(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """A row for each decision point of documents with maps ``p`` (point -> text), ``pm`` (point -> meta), ``v`` (point -> event) and
    ``ve`` (event -> tally): the kept columns, ``point``, ``text``, ``meta``, ``event`` and ``tally``."""
    each = docs.select(*keep, F.explode("p").alias("point", "text"), "pm", "v", "ve")
    event = F.try_element_at(F.col("v"), F.col("point"))
    return each.select(*keep, "point", "text", F.try_element_at(F.col("pm"), F.col("point")).alias("meta"), event.alias("event"), F.try_element_at(F.col("ve"), event).alias("tally"))
