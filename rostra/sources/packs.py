"""Readers of published packs: assigned JSON, multi-part manifests, stride arrays, dictionaries, NDJSON and positional parts."""

from __future__ import annotations

import base64
import gzip
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRIDE = 6
VOTE_FIELDS = ("doc_index", "point", "name", "party", "vote", "participant_id")
_STATED = ",".join(f"{c}:int" for c in ("stated_yes", "stated_no", "stated_abstain", "stated_absent"))
#: What is known of a point, and of a vote event. Numbers of pages come as texts, as some are none.
POINT_META = (
    "struct<" + ",".join(f"{c}:string" for c in (
        "result", "decision_level", "decision_stage", "decision_disposition", "decision_subject", "matter_type", "matter_type_state", "matter_outcome", "confidence", "decision_point_id", "matter_id",
        "source_url", "local_path", "source_page", "source_page_end", "extraction_status",
    )) + f",{_STATED}>"
)
VOTE_EVENT = (
    "struct<points:array<string>," + ",".join(f"{c}:string" for c in ("source_kind", "vote_type", "vote_status", "tally_status", "yes_meaning", "no_meaning", "inferred_from"))
    + f",{_STATED},{_STATED.replace('stated_', 'source_stated_')},count_conflict:boolean>"
)
DOCUMENT = (
    "struct<i:string,mi:string,dt:string,t:string,ht:string,ad:string,yd:string,pd:string,vd:string,bd:string,p:map<string,string>,"
    f"pm:map<string,{POINT_META}>,v:map<string,string>,ve:map<string,{VOTE_EVENT}>,"
    "b:string,bt:string,doc:string,u:string,lp:string,dn:string,cn:string,mt:string,mo:string,cf:string>"
)
PACK = f"struct<schema:string,pf:string,pt:string,d:array<{DOCUMENT}>,r:array<string>,pr:array<string>,mr:array<string>>"


def assigned_json(spark: SparkSession, paths: str | Sequence[str], marker: str, schema: str) -> DataFrame:
    """(file, data): files of the form ``marker = {json};``, parsed by an explicit schema."""
    raw = spark.read.text(paths if isinstance(paths, str) else list(paths), wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    body = F.rtrim(F.regexp_replace("value", rf"(?s)^.*?{marker}\s*=\s*", ""), F.lit("; \t\r\n"))
    return raw.select("file", F.from_json(body, schema).alias("data"))


def documents(packs: DataFrame) -> DataFrame:
    """Documents of parsed packs (file, data) as ``pack_rules`` reads them: doc is the place among all packs, by file and place."""
    each = packs.select("file", F.posexplode("data.d").alias("n", "d"))
    sizes = packs.select("file", F.coalesce(F.size("data.d"), F.lit(0)).alias("c"))  # a row for each file
    before = sizes.select("file", F.coalesce(F.sum("c").over(W.orderBy(part_number(F.col("file")), "file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    placed = each.join(before, "file").withColumn("doc", (F.col("b") + F.col("n")).cast("bigint"))
    return placed.select("doc", F.col("d.i").alias("id"), F.col("d.dt").alias("date"), F.col("d.b").alias("body"), F.col("d.doc").alias("title"), F.col("d.u").alias("url"), F.col("d.ht").alias("header"), F.col("d.ad").alias("description"), F.col("d.bd").alias("decision"), "d.p", "d.pm", "d.v", "d.ve")


def part_number(file: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(file, r"([0-9]+)\.[a-z]+$", 1), F.lit("")).try_cast("int"), F.lit(0))


def unstrided(df: DataFrame, keep: Sequence[str], flat: Column, names: Sequence[str] = VOTE_FIELDS) -> DataFrame:
    """Rows of a flat row-major array; lengths that the stride does not divide are refused."""
    n = len(names)

    def rows(f: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.floor(F.size(f) / n).cast("int") - 1), lambda i: F.struct(*[F.get(f, i * n + k).alias(c) for k, c in enumerate(names)], i.alias("ord")))
        return F.when(F.size(f) == 0, F.slice(each, 1, 0)).when(F.size(f) % n != 0, F.raise_error(F.lit("flat array is not a multiple of its stride"))).otherwise(each)

    # bound by a lambda, the array is worked out once for a row, however many values are taken from it
    return df.select(*keep, F.inline(F.flatten(F.transform(F.array(F.coalesce(flat, F.array().cast("array<string>"))), rows))))


def read_pack(spark: SparkSession, paths: Sequence[str], marker: str = r"window\.[A-Za-z]+") -> dict[str, DataFrame]:
    """Documents, votes, positions and attendance of a pack in parts, numbered over all parts in their order."""
    parts = assigned_json(spark, paths, marker, PACK).select(part_number(F.col("file")).alias("part"), "data.*")
    docs = parts.select("part", F.posexplode("d").alias("pos", "x")).select("part", "pos", "x.*")
    return {
        "documents": docs,
        "votes": unstrided(parts, ["part"], F.col("r")),
        "positions": unstrided(parts, ["part"], F.col("pr"), ("doc_index", "point", "name", "party", "stance", "proposal_id")),
        "attendance": unstrided(parts, ["part"], F.col("mr"), ("date", "body", "document_title", "name", "party", "role")),
    }


def decoded_dictionary(rows: DataFrame, row: str, strings: str, columns: Sequence[str], coded: Sequence[str]) -> DataFrame:
    """Named columns of array rows; values of coded columns are places in the array of strings."""
    def value(i: int, c: str) -> Column:
        v = F.get(F.col(row), F.lit(i))
        return (F.get(F.col(strings), v.try_cast("int")) if c in coded else v).alias(c)

    return rows.select(*[value(i, c) for i, c in enumerate(columns)])


#: Rows of an Arrow batch of whole texts, at most.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to BATCH_ROWS for ``gzipped`` and ``gunzipped``, whose workers hold a batch's texts several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


@F.pandas_udf(T.StringType())
def gunzipped(texts: pd.Series) -> pd.Series:
    """``gz:`` and base64 to text; other texts as they are."""
    return texts.map(lambda t: gzip.decompress(base64.b64decode(t[3:])).decode() if t and t.startswith("gz:") else t)


@F.pandas_udf(T.StringType())
def gzipped(texts: pd.Series) -> pd.Series:
    """Texts as ``gz:`` and base64, the inverse of ``gunzipped``."""
    return texts.map(lambda t: None if t is None else "gz:" + base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode())


def ndjson(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(meta row, data rows) of newline-delimited JSON, compressed or not."""
    raw = spark.read.text(path)
    kind = F.get_json_object("value", "$.type")
    meta = raw.where(kind == "meta").select(F.from_json("value", "struct<type:string,total:bigint,meetings:bigint>").alias("m")).select("m.*")
    return meta, raw.where(kind.isNull() | (kind != "meta")).select(F.from_json("value", schema).alias("r")).select("r.*")


def positional(df: DataFrame, row: str, fields: Sequence[str]) -> DataFrame:
    """Columns of trimmed arrays: places beyond the end are null."""
    return df.select(*[F.get(F.col(row), F.lit(i)).alias(f) for i, f in enumerate(fields)])


def without_bootstrap(rows: DataFrame, bootstrap: DataFrame, key: str) -> DataFrame:
    """Rows that the bootstrap has not shown yet."""
    return rows.join(bootstrap.select(key), key, "left_anti")
