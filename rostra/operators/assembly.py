"""Documents assembled from protocol records: ids, matters, points with their metadata, vote events and rows, and the gate before publishing (PRS-12, SRC-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostra.functions.keys import slug, squeezed, stable_hash, text_or_empty
from rostra.operators import quality
from rostra.operators.records import FIELDS, TALLY
from rostra.sources.sinks import publish

#: Kinds of bodies by name and by the beginning of a name; others are committees. Fixed values.
BODY_TYPES = {"kommunfullmäktige": "kommunfullmaktige", "kommunstyrelsen": "kommunstyrelsen"}
BODY_STARTS = {"kommunstyrelsens ": "kommunstyrelseutskott"}
COMMITTEE = "namnd"
#: Status of a point without a decision. Fixed value.
NOT_EXTRACTED = "decision_not_extracted"


def body_type(body: Column) -> Column:
    low = F.lower(text_or_empty(body))
    found = [F.when(low == k, v) for k, v in BODY_TYPES.items()] + [F.when(low.startswith(k), v) for k, v in BODY_STARTS.items()]
    return F.coalesce(*found, F.lit(COMMITTEE))


def section_points(section: Column, decision: Column) -> Column:
    """Array of (point, decision): the numbered items, each after the preamble; a decision without items is one point.

    Of items with the same number the last counts. All within the row.
    """
    text = text_or_empty(decision)
    blocks = F.split(text, r"\n(?=\s*[0-9]+\.)")
    number = lambda b: F.regexp_extract(b, r"^\s*([0-9]+)\.", 1)
    items = F.filter(blocks, lambda b: number(b) != "")
    before = F.get(F.filter(blocks, lambda b: number(b) == ""), F.lit(0))
    said = lambda b: squeezed(F.concat_ws(" ", before, squeezed(F.regexp_replace(b, r"^\s*[0-9]+\.\s*", ""))))
    made = F.transform(items, lambda b: F.struct(F.concat_ws(".", section, number(b)).alias("point"), said(b).alias("decision")))
    last = F.filter(made, lambda x, i: ~F.exists(F.slice(made, i + 2, F.size(made)), lambda y: y["point"] == x["point"]))
    return F.when(F.size(items) > 0, last).otherwise(F.array(F.struct(section.alias("point"), squeezed(text).alias("decision"))))


def documents(records: DataFrame, known: DataFrame, doc: str) -> DataFrame:
    """A document for each record of a protocol, with its maps ``p``, ``pm``, ``v`` and ``ve``, and the roll call ``votes``.

    ``records``: of ``protocol_records``; ``known``: (doc, date, body, title, url, path, include, section_urls), where
    ``include`` names the sections wanted (all, if none) and ``section_urls`` maps sections to urls of their own.

    An id is made of body, date and section; later sections of the same number add a hash of url, number and title. A matter
    is named by body and diary number, or title; a decision point by document, point and text, if it has one. Points carry
    class, status, source and, where a vote was held, the counts stated. An event's roll call belongs to the first point.
    """
    k = known.select(doc, *[text_or_empty(F.col(c)).alias(f"k_{c}") for c in ("date", "body", "title", "url", "path")], F.col("include").alias("k_include"), F.col("section_urls").alias("k_urls"))
    rows = records.join(k, doc).where((F.coalesce(F.size("k_include"), F.lit(0)) <= 0) | F.array_contains("k_include", F.col("section")))
    url = F.coalesce(F.nullif(F.try_element_at("k_urls", F.col("section")), F.lit("")), F.col("k_url"))
    base = F.concat_ws("_", F.lit("case_body"), slug(F.col("k_body"), "_"), F.replace("k_date", F.lit("-"), F.lit("_")), slug(F.col("section"), "_"))
    rows = rows.withColumn("k_url", url).withColumn("base", base).withColumn("nth", F.row_number().over(W.partitionBy(doc, "base").orderBy("s")))
    own = F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.substring(stable_hash(F.col("k_url"), F.col("section"), F.col("title")), 1, 8)))
    matter = F.concat(F.lit("matter_"), stable_hash(F.col("k_body"), F.when(F.col("diary") != "", F.col("diary")).otherwise(F.col("title"))))
    rows = rows.withColumn("i", own).withColumn("mi", matter).withColumn("points", section_points(F.col("section"), F.col("bd")))
    informed, decided, plain = F.col("outcome") == "information_only", F.col("bd") != "", ~F.col("result").isin("other", NOT_EXTRACTED)
    stated = [F.when(F.col("held"), F.col(f"stated.{c}")).alias(f"stated_{c}") for c, _ in TALLY]
    meta = lambda x: F.struct(
        F.col("result"), F.when(informed, "information_only").when(decided, "final_decision").otherwise("unknown").alias("decision_level"), F.when(informed, "information").when(decided, "final").otherwise("consideration").alias("decision_stage"),
        F.when(informed, "acknowledge").when(plain, F.col("result")).otherwise("other").alias("decision_disposition"), F.col("matter_type"), F.when(F.col("matter_type") == "unclassified", "unclassified").otherwise("classified").alias("matter_type_state"),
        F.col("outcome").alias("matter_outcome"), F.col("confidence"), F.when(x["decision"] != "", F.concat(F.lit("decision_point_"), stable_hash(F.col("i"), x["point"], x["decision"]))).alias("decision_point_id"), F.col("mi").alias("matter_id"),
        F.col("k_url").alias("source_url"), F.col("k_path").alias("local_path"), F.col("first_page").alias("source_page"), F.col("last_page").alias("source_page_end"), F.when(decided, "formal_decision").otherwise(NOT_EXTRACTED).alias("extraction_status"), *stated,
    )
    event, n = F.concat(F.lit("vote_"), F.col("i"), F.lit("_1")), F.size("named")
    names = F.transform("points", lambda x: x["point"])
    counted = F.coalesce(*[F.col(f"stated.{c}") for c, _ in TALLY]).isNotNull()
    told = F.struct(
        names.alias("points"), F.lit("formal_vote").alias("source_kind"), F.when(n > 0, "roll_call").otherwise("recorded_tally").alias("vote_type"), F.when(n > 0, "held_roll_call").otherwise("held_tally_only").alias("vote_status"),
        F.when(counted, "stated").otherwise("unknown").alias("tally_status"), *stated,
    )
    ballots = F.transform("named", lambda x, at: F.struct(F.get(names, F.lit(0)).alias("point"), x["name"].alias("name"), x["party"].alias("party"), x["vote"].alias("vote"), F.concat(event, F.lit(":"), (at + 1).cast("string")).alias("participant")))
    return rows.select(
        doc, "s", "i", "mi", F.col("k_date").alias("dt"), F.col("title").alias("t"), F.concat(F.lit("§ "), F.col("section"), F.lit(" "), F.col("title")).alias("ht"), *FIELDS,
        F.map_from_entries("points").alias("p"), F.map_from_entries(F.transform("points", lambda x: F.struct(x["point"], meta(x)))).alias("pm"),
        F.when(F.col("held"), F.map_from_entries(F.transform("points", lambda x: F.struct(x["point"], event)))).alias("v"), F.when(F.col("held"), F.create_map(event, told)).alias("ve"), ballots.alias("votes"),
        F.col("k_body").alias("b"), body_type(F.col("k_body")).alias("bt"), F.col("k_title").alias("doc"), F.col("k_url").alias("u"), F.col("k_path").alias("lp"), F.col("diary").alias("dn"), F.col("matter_type").alias("mt"), F.col("outcome").alias("mo"), F.col("confidence").alias("cf"),
    )


def supplement_issues(made: DataFrame, known: DataFrame, doc: str) -> DataFrame:
    """(doc, section, code, severity): wanted sections that no document has. ``section`` names the missing one."""
    wanted = known.select(doc, F.explode("include").alias("section")).where("section <> ''").distinct()
    found = made.select(doc, F.regexp_extract("ht", r"^§ (\S+)", 1).alias("section")).distinct()
    return wanted.join(found, [doc, "section"], "left_anti").select(doc, "section", F.lit("supplement_sections_missing").alias("code"), F.lit("review").alias("severity"))


def publish_if_clean(spark: SparkSession, made: DataFrame, issues: DataFrame, path: str, blocking=("error", "review")) -> bool:
    """Publishes the documents below ``path`` unless an issue blocks it; what was published before stays then. All or nothing, as one pack."""
    if not quality.gate(issues, blocking).head()["passes"]:
        return False
    n = made.count()
    return publish(spark, made, path, lambda df: df.count() == n)
