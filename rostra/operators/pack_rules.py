"""Integrity of packs: documents with their nested maps of points, point metadata, votes by point and vote events, and the rows beside them.

Documents: (doc, id, date, body, title, url, header, description, decision, p, pm, v, ve), where ``p`` maps points to texts,
``pm`` points to metadata, ``v`` points to comma-separated events, ``ve`` events to what is known of them. ``doc`` is the
place by which rows name a document, unique. Issues are rows (doc, code, item), where ``item`` names a point, an event, a
field or a row within the document. Null maps are empty, null texts empty. Empty tables: no issues.

All maps of a document lie in its row, so points, metadata and events are matched there, in one pass and without a shuffle;
only ids that must not repeat, and the rows of other tables, are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.functions.keys import text_or_empty
from rostra.functions.text import normalize_text

#: Status of a point whose decision is known to be missing. Fixed value.
NOT_EXTRACTED = "decision_not_extracted"
#: A meaning that ends in an abbreviation or a conjunction was cut off. Fixed pattern.
TRUNCATED = r"(?iu)(?:(?<![A-Za-z0-9_])m|(?<![A-Za-z0-9_])m\.f|(?<![A-Za-z0-9_])m\.fl|(?<![A-Za-z0-9_])(?:och|samt|till|mot|respektive))$"
#: Votes, and where an event states how many there were. Fixed values.
VOTES = {"Ja": "stated_yes", "Nej": "stated_no", "Avstår": "stated_abstain", "Frånvarande": "stated_absent"}
ABSENT = "Frånvarande"
DATE = r"^20[0-9]{2}-[0-9]{2}-[0-9]{2}$"


def _keys(m: str) -> Column:
    return F.coalesce(F.map_keys(m), F.array().cast("array<string>"))


def _entries(m: str) -> Column:
    return F.coalesce(F.map_entries(m), F.array())


def _number(text: Column) -> Column:
    """A text's number; an empty one is 0, another text none."""
    plain = F.trim(text_or_empty(text))
    return F.when(plain == "", 0.0).otherwise(plain.try_cast("double"))


def _base(point: Column) -> Column:
    return F.substring_index(point, ".", 1)


def point_table(docs: DataFrame) -> DataFrame:
    """(doc, point, has_text, has_meta, text, meta): every point that a document's texts or metadata name, from one pass."""
    both = docs.withColumn("point", F.explode(F.array_union(_keys("p"), _keys("pm"))))
    held = lambda m: F.coalesce(F.map_contains_key(m, F.col("point")), F.lit(False))
    meta = F.try_element_at("pm", F.col("point"))
    return both.withColumns({"has_text": held("p"), "has_meta": held("pm") & meta.isNotNull(), "in_meta": held("pm"), "text": text_or_empty(F.try_element_at("p", F.col("point"))), "meta": meta})


def point_issues(docs: DataFrame, boilerplate: str) -> DataFrame:
    """(doc, code, item) of points, their metadata and the maps of votes.

    ``empty_decision_point``: no text, though it is not known to be missing; ``missing_point_metadata``;
    ``invalid_source_page``: no whole number from 1; ``invalid_source_page_range``: ends before it begins;
    ``point_source_url_mismatch``; ``header_point_mismatch``: the header names another point; ``orphan_point_metadata``;
    ``duplicate_decision_point_id``: known from an earlier document, or an earlier point of it; ``vote_map_missing_point``:
    no point of that base; ``vote_map_missing_event``; ``truncated_vote_meaning``; ``extraction_boilerplate``.
    """
    points = point_table(docs)
    page, end = _number(F.col("meta.source_page")), F.col("meta.source_page_end")
    last = F.when(text_or_empty(end) == "", page).otherwise(_number(end))
    url, wrong = text_or_empty(F.col("meta.source_url")), boilerplate
    in_header = F.regexp_extract(text_or_empty(F.col("header")), r"§\s*([0-9]{1,4})", 1)
    base = F.regexp_extract("point", r"^([0-9]{1,4})", 1)
    text, meta = F.col("has_text"), F.col("has_meta")
    rules = {
        "extraction_boilerplate": text & F.col("text").rlike(wrong),
        "empty_decision_point": text & (F.trim(F.col("text")) == "") & ~F.coalesce(F.col("meta.extraction_status") == NOT_EXTRACTED, F.lit(False)),
        "missing_point_metadata": text & ~meta,
        "invalid_source_page": text & meta & ~F.coalesce((page >= 1) & (page == F.floor(page)), F.lit(False)),
        "invalid_source_page_range": text & meta & F.coalesce(last < page, F.lit(False)),
        "point_source_url_mismatch": text & meta & (url != "") & (url != text_or_empty(F.col("url"))),
        "header_point_mismatch": text & meta & (in_header != "") & (base != "") & (in_header != base),
        "orphan_point_metadata": F.col("in_meta") & ~text,
    }
    codes = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in rules.items()]))
    found = points.select("doc", F.explode(codes).alias("code"), F.col("point").alias("item"))
    return found.unionByName(_repeated_point_ids(points)).unionByName(_vote_map_issues(docs)).unionByName(_field_issues(docs, boilerplate))


def _repeated_point_ids(points: DataFrame) -> DataFrame:
    named = points.where("has_text and has_meta").select("doc", F.col("point").alias("item"), text_or_empty(F.col("meta.decision_point_id")).alias("k")).where("k <> ''")
    # the first of each id, by partial aggregation: a hot id is no hot group
    first = named.groupBy("k").agg(F.min(F.struct("doc", "item")).alias("first"), F.count("*").alias("n")).where("n > 1").select("k", "first")
    return named.join(first, "k").where(F.struct("doc", "item") != F.col("first")).select("doc", F.lit("duplicate_decision_point_id").alias("code"), "item")


def _vote_map_issues(docs: DataFrame) -> DataFrame:
    votes = docs.select("doc", _keys("p").alias("points"), _keys("ve").alias("events"), F.explode(_entries("v")).alias("v"))
    # an exact point, or one of the same base
    missing = ~F.exists("points", lambda p: (p == F.col("v.key")) | (_base(p) == _base(F.col("v.key"))))
    split = F.filter(F.transform(F.split(text_or_empty(F.col("v.value")), ","), lambda e: F.trim(e)), lambda e: e != "")
    unknown = F.array_except(split, "events")
    item = F.col("v.key")
    of_points = votes.where(missing).select("doc", F.lit("vote_map_missing_point").alias("code"), item.alias("item"))
    of_events = votes.select("doc", F.lit("vote_map_missing_event").alias("code"), F.explode(F.transform(unknown, lambda e: F.concat(item, F.lit("|"), e))).alias("item"))
    events = docs.select("doc", F.explode(_entries("ve")).alias("e"))
    cut = F.array_compact(F.array(*[F.when(F.trim(text_or_empty(F.col(f"e.value.{f}"))).rlike(TRUNCATED), F.concat(F.col("e.key"), F.lit(f"|{f}"))) for f in ("yes_meaning", "no_meaning")]))
    return of_points.unionByName(of_events).unionByName(events.select("doc", F.lit("truncated_vote_meaning").alias("code"), F.explode(cut).alias("item")))


def _field_issues(docs: DataFrame, boilerplate: str) -> DataFrame:
    left = F.array_compact(F.array(*[F.when(text_or_empty(F.col(f)).rlike(boilerplate), F.lit(f)) for f in ("header", "description", "decision")]))
    return docs.select("doc", F.lit("extraction_boilerplate").alias("code"), F.explode(left).alias("item"))


def document_issues(docs: DataFrame, cutoff: str, domain: str) -> DataFrame:
    """(doc, code, item) of documents: a repeated or missing id (all but the first), no date, one before ``cutoff``, another date
    at the start of the title, a url that is none, or that is not https of ``domain`` or below it."""
    date, title, url = (text_or_empty(F.col(c)) for c in ("date", "title", "url"))
    in_title = F.regexp_extract(title, r"^(20[0-9]{2}-[0-9]{2}-[0-9]{2})", 1)
    scheme, host = F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    official = (scheme == "https") & ((host == domain) | host.endswith(f".{domain}"))
    good, is_url = date.rlike(DATE), (scheme != "") & (~scheme.isin("http", "https") | (host != ""))
    rules = {
        "missing_document_id": text_or_empty(F.col("id")) == "", "invalid_document_date": ~good, "document_before_public_cutoff": good & (date < cutoff),
        "document_title_date_mismatch": (in_title != "") & (in_title != date), "invalid_source_url": ~is_url, "non_official_source_url": is_url & ~official,
    }
    codes = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in rules.items()]))
    found = docs.select("doc", F.explode(codes).alias("code"), F.col("id").alias("item"))
    named = docs.where(text_or_empty(F.col("id")) != "").select("doc", "id")
    first = named.groupBy("id").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").select("id", "first")
    again = named.join(first, "id").where("doc <> first").select("doc", F.lit("duplicate_document_id").alias("code"), F.col("id").alias("item"))
    return found.unionByName(again)


def _event(participant: Column) -> Column:
    """The event in a row's participant id: all before the last colon, or the whole."""
    text = text_or_empty(participant)
    return F.when(F.contains(text, F.lit(":")), F.regexp_extract(text, r"(?s)^(.*):[^:]*$", 1)).otherwise(text)


def vote_issues(docs: DataFrame, votes: DataFrame) -> DataFrame:
    """(doc, code, item) of vote rows (row, doc, point, name, party, vote, participant).

    ``vote_row_invalid_document``, ``vote_row_missing_point``, ``vote_row_invalid_value``, ``vote_row_missing_event``; and
    ``named_votes_exceed_protocol_total`` where an event names more of one vote than it states of it, unless the conflict is
    known (``count_conflict``). Each vote is counted by itself, so absent members raise nothing against yes votes. A vote
    that an event does not state is not compared.
    """
    rows = votes.select(F.col("row").cast("string").alias("row"), "doc", text_or_empty(F.col("point")).alias("point"), text_or_empty(F.col("vote")).alias("vote"), _event(F.col("participant")).alias("event"))
    known = docs.select("doc", _keys("p").alias("points"), "ve", F.lit(1).alias("known"))
    both = rows.join(known, "doc", "left")
    there = F.col("known").isNotNull()
    stated = F.try_element_at("ve", F.col("event"))
    rules = {
        "vote_row_invalid_document": ~there, "vote_row_missing_point": there & ~F.array_contains(F.coalesce("points", F.array().cast("array<string>")), F.col("point")),
        "vote_row_invalid_value": there & ~F.col("vote").isin(*VOTES), "vote_row_missing_event": there & stated.isNull(),
    }
    found = both.select("doc", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in rules.items()]))).alias("code"), F.col("row").alias("item"))
    counted = rows.groupBy("doc", "point", "event").agg(*[F.count_if(F.col("vote") == v).alias(c) for v, c in VOTES.items()])
    against = counted.join(known.select("doc", "ve"), "doc").withColumn("e", F.try_element_at("ve", F.col("event"))).where("e is not null and not coalesce(e.count_conflict, false)")
    over = [F.when(F.col(f"e.{c}").isNotNull() & (F.col(c) > F.coalesce(_number(F.col(f"e.{c}").cast("string")), F.lit(0.0))), F.lit(v)) for v, c in VOTES.items()]
    more = against.select("doc", F.lit("named_votes_exceed_protocol_total").alias("code"), "point", "event", F.explode(F.array_compact(F.array(*over))).alias("vote"))
    return found.unionByName(more.select("doc", "code", F.concat_ws("|", "point", "event", "vote").alias("item")))


def vote_conflicts(docs: DataFrame, votes: DataFrame) -> DataFrame:
    """(doc, event, named and stated counts): known conflicts between names and numbers, once for each document and event, of its
    first point. What the source states comes before what was stated after correction."""
    rows = votes.select("doc", text_or_empty(F.col("point")).alias("point"), text_or_empty(F.col("vote")).alias("vote"), _event(F.col("participant")).alias("event"))
    counted = rows.groupBy("doc", "event", "point").agg(*[F.count_if(F.col("vote") == v).alias(f"named_{c[7:]}") for v, c in VOTES.items()])
    held = counted.join(docs.select("doc", "ve"), "doc").withColumn("e", F.try_element_at("ve", F.col("event"))).where("e.count_conflict")
    names = [f"named_{c[7:]}" for c in VOTES.values()]
    stated = [F.coalesce(_number(F.coalesce(F.col(f"e.source_{c}"), F.col(f"e.{c}")).cast("string")), F.lit(0.0)).cast("bigint").alias(c) for c in VOTES.values()]
    first = held.groupBy("doc", "event").agg(F.min_by(F.struct("point", *names, *stated), "point").alias("s"))
    return first.select("doc", "event", "s.*")


def position_issues(docs: DataFrame, positions: DataFrame) -> DataFrame:
    """(doc, code, item) of position rows (row, doc, point): their document and point exist."""
    known = docs.select("doc", _keys("p").alias("points"), F.lit(1).alias("known"))
    both = positions.select(F.col("row").cast("string").alias("row"), "doc", text_or_empty(F.col("point")).alias("point")).join(known, "doc", "left")
    there = F.col("known").isNotNull()
    code = F.when(~there, "position_row_invalid_document").when(~F.array_contains("points", F.col("point")), "position_row_missing_point")
    return both.select("doc", code.alias("code"), F.col("row").alias("item")).where("code is not null")


def attendance_issues(docs: DataFrame, votes: DataFrame, attendance: DataFrame) -> DataFrame:
    """(doc, code, item) of attendance (row, date, body, title, name, party): its meeting has a document
    (``attendance_row_unmatched_protocol``, without doc), and everyone who voted was there, by folded name and party
    (``named_voter_missing_from_attendance``). Who is named absent need not be there; votes without a document are not asked for."""
    key = [text_or_empty(F.col(c)).alias(c) for c in ("date", "body", "title")]
    meetings = docs.select(*key).distinct()
    rows = attendance.select(F.col("row").cast("string").alias("item"), *key, normalize_text(F.col("name")).alias("who"), normalize_text(F.col("party")).alias("of"))
    unmatched = rows.join(meetings, ["date", "body", "title"], "left_anti").select(F.lit(None).cast(docs.schema["doc"].dataType).alias("doc"), F.lit("attendance_row_unmatched_protocol").alias("code"), "item")
    cast = votes.where(text_or_empty(F.col("vote")) != ABSENT).select("row", "doc", normalize_text(F.col("name")).alias("who"), normalize_text(F.col("party")).alias("of"))
    asked = cast.join(docs.select("doc", *key), "doc")
    absent = asked.join(rows.select("date", "body", "title", "who", "of").distinct(), ["date", "body", "title", "who", "of"], "left_anti")
    return unmatched.unionByName(absent.select("doc", F.lit("named_voter_missing_from_attendance").alias("code"), F.col("row").cast("string").alias("item")))
