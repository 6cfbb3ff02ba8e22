"""References in texts, and the rows they mean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostra.functions.keys import MONTHS, swedish_date
from rostra.operators.joins import forward_asof
from rostra.sources.sinks import materialized

#: Forms of references. Fixed values.
SECTION, DIARY, ISO_DATE = r"§\s*[0-9]{1,4}(?:\.[0-9]+)?", r"[A-ZÅÄÖ][A-Za-zÅÄÖåäö]{0,6}\s+[0-9]+/20[0-9]{2}", r"20[0-9]{2}-[0-9]{2}-[0-9]{2}"
DAY = r"[0-9]{1,2}\s+(?:" + "|".join(f"[{m[0].upper()}{m[0]}]{m[1:]}" for m in MONTHS) + r")(?:\s+20[0-9]{2})?"
ANY = f"({SECTION}|(?<![A-Za-zÅÄÖåäö]){DIARY}(?![A-Za-zÅÄÖåäö])|(?<![A-Za-z0-9_]){ISO_DATE}(?![A-Za-z0-9_])|(?<![A-Za-z0-9_]){DAY}(?![A-Za-z0-9_]))"


def extract(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, pos, label, kind) of every reference in the text, in order."""
    found = df.select(id_col, F.posexplode(F.regexp_extract_all(text, F.lit(ANY), F.lit(1))).alias("pos", "label"))
    kind = F.when(F.startswith("label", F.lit("§")), "section").when(F.col("label").rlike(f"^{ISO_DATE}$"), "date").when(F.contains("label", F.lit("/")), "diary").otherwise("day")
    return found.withColumn("kind", kind)


#: A year by itself. Fixed value.
YEAR = r"(?<![A-Za-z0-9_])(20[0-9]{2})(?![A-Za-z0-9_])"
#: Characters from a date's start, and before it, in which its year is looked for.
AHEAD, BEHIND = 160, 120
#: Labels have three characters at least, so no more of them end in BEHIND characters.
_NEAR_LABELS = BEHIND // 3 + 1


def extract_dated(df: DataFrame, id_col: str, text: str, date: str) -> DataFrame:
    """``extract`` with ``full``, the label with its year, and ``iso``, the date it means (null for labels that are no date).

    A day without a year has the first one from its own place on within AHEAD characters, else the last one within BEHIND
    before it, else that of the row's ``date``; without any it stays as it is. What lies around a label is cut out within the
    row, from the pieces between labels. Null texts have no labels.
    """
    found, rest = F.regexp_extract_all(text, F.lit(f"{ANY}(?=([\\s\\S]{{0,{AHEAD}}}))"), F.lit(1)), F.regexp_extract_all(text, F.lit(f"{ANY}(?=([\\s\\S]{{0,{AHEAD}}}))"), F.lit(2))
    pieces = F.transform(F.split(text, ANY, -1), lambda x: F.substr(x, F.greatest(F.length(x) - BEHIND + 1, F.lit(1))))
    rows = df.select(id_col, F.col(date).cast("string").alias("own"), found.alias("labels"), rest.alias("rest"), pieces.alias("pieces"))
    each = rows.select(id_col, "own", "labels", "pieces", F.posexplode(F.arrays_zip("labels", "rest").alias("z")).alias("pos", "z")).select(id_col, "own", "labels", "pieces", "pos", F.col("z.labels").alias("label"), F.col("z.rest").alias("rest"))
    near = F.transform(F.sequence(F.greatest(F.col("pos") - _NEAR_LABELS, F.lit(0)), F.col("pos")), lambda j: F.concat(F.get("pieces", j), F.when(j < F.col("pos"), F.get("labels", j)).otherwise("")))
    joined = F.array_join(near, "")
    before = F.substr(joined, F.greatest(F.length(joined) - BEHIND + 1, F.lit(1)))
    after = F.substr(F.concat("label", "rest"), F.lit(1), F.lit(AHEAD))
    kind = F.when(F.startswith("label", F.lit("§")), "section").when(F.col("label").rlike(f"^{ISO_DATE}$"), "date").when(F.contains("label", F.lit("/")), "diary").otherwise("day")
    none = F.lit("")
    year = F.coalesce(F.nullif(F.regexp_extract(after, YEAR, 1), none), F.try_element_at(F.regexp_extract_all(before, F.lit(YEAR), F.lit(1)), F.lit(-1)), F.nullif(F.substring(F.coalesce("own", none), 1, 4), none))
    full = F.when((F.col("kind") == "day") & ~F.col("label").rlike(YEAR), F.concat_ws(" ", "label", year)).otherwise(F.col("label"))
    iso = F.when(F.col("kind") == "date", F.col("label")).when((F.col("kind") == "day") & F.col("full").rlike(YEAR), swedish_date(F.regexp_replace("full", r"\s+", " "), F.lit(None)))
    return each.withColumn("kind", kind).withColumn("full", full).select(id_col, "pos", "label", "kind", "full", iso.alias("iso"))


def as_targets(found: DataFrame) -> DataFrame:
    """References with labels as ``targets`` asks for them: points by their base number, diary numbers in normal form, days and dates as ISO dates."""
    label = (
        F.when(F.col("kind") == "section", F.regexp_extract("label", "([0-9]{1,4})", 1)).when(F.col("kind") == "diary", F.regexp_replace(F.lower("label"), r"\s+", " "))
        .otherwise(F.col("iso"))
    )
    return found.withColumn("label", label).withColumn("kind", F.when(F.col("kind") == "day", "date").otherwise(F.col("kind"))).drop("full", "iso")


#: What rows and the rows that refer are known by.
ROW = ("id", "doc", "date", "body", "matter", "diary", "point")


def _nearest(refs: DataFrame, rows: DataFrame, pool: Sequence[str]) -> DataFrame:
    """(ref, target) among rows with the same ``pool`` columns, where the current row is none of them: same diary, the next of
    the same matter on or after the current date, the first of that matter, the first of all.

    Each step is a join with one row for each key, or a scan along the dates, so no reference meets all its candidates.
    """
    keys = list(pool)
    refs = refs.select("ref", *keys, *[c for c in ("diary", "matter", "date") if c not in keys])  # no more is shuffled
    first = lambda more, order, name: rows.groupBy(*keys, *more).agg((F.min("id") if order == ["id"] else F.min_by("id", F.struct(*order))).alias(name))
    found = refs.join(first([], ["id"], "t_any"), keys, "left").join(first(["diary"], ["id"], "t_diary"), [*keys, "diary"], "left")
    # only what has a matter asks by it, so rows without one are no hot key
    rows = rows.where("matter is not null")
    if "date" in keys:  # all are of the current date, so the first of the matter is the next one
        led = refs.join(first(["matter"], ["point", "id"], "t_matter"), [*keys, "matter"]).select("ref", "t_matter")
        return found.join(led, "ref", "left").select("ref", F.coalesce("t_diary", "t_matter", "t_any").alias("target"))
    led = forward_asof(refs.where("matter is not null"), rows.groupBy(*keys, "matter", "date").agg(F.min_by("id", F.struct("point", "id")).alias("t_next")), [*keys, "matter"], "date", "date", "t_next")
    led = led.join(first(["matter"], ["date", "point", "id"], "t_matter"), [*keys, "matter"], "left").select("ref", F.coalesce("t_next", "t_matter").alias("t_matter"))
    return found.join(led, "ref", "left").select("ref", F.coalesce("t_diary", "t_matter", "t_any").alias("target"))


def _near(refs: DataFrame, rows: DataFrame, pool: Sequence[str]) -> DataFrame:
    """(ref, target) among the few rows of one document: the current row itself, same diary, then as in ``_nearest``."""
    keys = list(pool)
    mine = refs.select("ref", *keys, *[F.col(c).alias(f"own_{c}") for c in ROW if c not in keys])
    both = mine.join(rows, keys)
    own = lambda c: F.col(c) if c in keys else F.col(f"own_{c}")
    same = lambda c: F.coalesce(F.col(c) == own(c), F.lit(False))
    other = ~same("id")
    meeting = same("date") & same("body")
    rank = (
        F.when(same("id") & same("point"), 0).when(same("diary") & same("doc"), 1).when(same("diary") & meeting, 2).when(same("diary"), 3)
        .when(other & same("matter") & (F.col("date") >= own("date")), 4).when(other & same("matter"), 5).when(other & same("doc"), 6).when(other, 7).otherwise(8)
    )
    # within a rank: by date and point among rows of a matter, by point in the same document, else as the rows come
    by_date, by_point = F.when(rank.isin(4, 5), F.col("date")), F.when(rank.isin(4, 5, 6), F.col("point"))
    return both.groupBy("ref").agg(F.min_by("id", F.struct(rank, by_date, by_point, F.col("id"))).alias("target"))


def _of_meeting(refs: DataFrame, rows: DataFrame, pool: Sequence[str]) -> DataFrame:
    """(ref, target) among a meeting's rows, which may be many. What a document's pool left has no row of its own document here, so
    the current row is none of them, unless it is of no document."""
    apart = F.col("doc").isNull()
    return _nearest(refs.where(~apart), rows, pool).unionByName(_near(refs.where(apart), rows, pool))


def _pooled(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """(ref, target, pool) by the first pool that has a row with the label: same document, same meeting, same body (for points), all.

    ``by`` tells points' labels from diary numbers, so that both go through the pools together.
    """
    pools = [("document", _near, ["by", "label", "doc"]), ("meeting", _of_meeting, ["by", "label", "date", "body"]), ("body", _nearest, ["by", "label", "body"]), ("all", _nearest, ["by", "label"])]
    left, out = refs.where("label is not null"), None
    for name, way, pool in pools:
        asks = left.where("by = 'section'") if name == "body" else left
        # a table, as the next pool asks what this one left
        found = materialized(way(asks, rows, pool).where("target is not null").withColumn("pool", F.lit(name)))
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select("ref"), "ref", "left_anti")
    return out


def targets(refs: DataFrame, rows: DataFrame, meetings: DataFrame) -> DataFrame:
    """(ref, kind, target, pool) of references.

    ``refs``: (ref, kind, label), the current row's columns ROW, and ``url``; ``label`` is a point's base number, a diary
    number in normal form, or a date in ISO form. ``rows``: ROW and ``base``; ``meetings``: (id, date, body).

    A point means a row of that base number, a diary number a row of that diary, each in the nearest pool. A date means the
    current meeting where it is its date, else a row of the same matter on that date. A reference that finds nothing or its
    own row falls back to the source (pool ``source``) if the current row has a url; dates stay text.
    """
    refs, rows = materialized(refs), materialized(rows)
    labelled = lambda c, by: rows.where(F.col(c).isNotNull()).select(F.lit(by).alias("by"), F.col(c).alias("label"), *ROW)
    diary = refs.where("kind = 'diary'")
    own = diary.where("diary = label").select("ref", F.col("id").alias("target"), F.lit("own").alias("pool"))
    asked = diary.where("diary is null or diary <> label")
    asks = refs.where("kind = 'section'").unionByName(asked).withColumnRenamed("kind", "by")
    found = _pooled(asks, labelled("base", "section").unionByName(labelled("diary", "diary"))).unionByName(own)
    day = refs.where("kind = 'date'").select("ref", "id", "matter", "body", "label", F.col("date").alias("own_date"))
    held = meetings.groupBy("date", "body").agg(F.min("id").alias("meeting"))
    day = day.join(held, (day.label == held.date) & (day.body == held.body) & (day.own_date == held.date), "left").select(day["*"], "meeting")
    same = rows.where("matter is not null").select(F.col("date").alias("label"), "matter", F.col("id").alias("row"))
    # the first two rows of a date and matter are enough: one of them is not the current row
    nth = F.dense_rank().over(W.partitionBy("label", "matter").orderBy("row"))
    two = same.withColumn("nth", nth).where("nth <= 2").groupBy("label", "matter").agg(F.min("row").alias("one"), F.max("row").alias("two"))
    other = F.when(F.col("one") != F.col("id"), F.col("one")).when(F.col("two") != F.col("id"), F.col("two"))
    dated = day.join(two, ["label", "matter"], "left").withColumn("row", other).select("ref", F.coalesce(F.when(F.col("meeting") != F.col("id"), F.col("meeting")), "row").alias("target"), F.when(F.col("meeting") != F.col("id"), "meeting").otherwise("matter").alias("pool"))
    every = refs.select("ref", "kind", "id", "url").join(found.unionByName(dated.where("target is not null")), "ref", "left")
    lost = F.col("target").isNull() | (F.col("target") == F.col("id"))
    return every.select(
        "ref", "kind", F.when(~lost, F.col("target")).alias("target"),
        F.when(~lost, F.col("pool")).when((F.col("kind") != "date") & F.col("url").isNotNull(), "source").otherwise("none").alias("pool"),
    )


def date_target(refs: DataFrame, rows: DataFrame, date: str, matter: str, own: str, target: str) -> DataFrame:
    """Dates mean the row of the same matter on that date; others stay text."""
    return refs.join(rows.select(date, matter, target), [date, matter]).where(F.col(target) != F.col(own)).groupBy(own, date, matter).agg(F.min(target).alias(target))
