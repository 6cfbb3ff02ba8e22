"""The driver tables in the roles of civic records, and the registry of named queries.

orders: decision points; lineitem: ballots; customer: people, their segments parties; nation: bodies; region: counties;
part: matters; events: meetings' timelines; documents and pages: protocols and listings; conversations: lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    return F.broadcast(table(spark, sf, "nation"))  # 25 rows at every scale


def points(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(bodies(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("date"), F.col("n_name").alias("body"), F.col("c_mktsegment").alias("party"), F.col("c_name").alias("member"),
        F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("result"), F.col("o_custkey").alias("matter"),
    )


POINTS = """points as (select o_orderkey as id, cast(o_orderdate as date) as date, n_name as body, c_mktsegment as party, c_name as member, o_orderpriority as kind,
  o_orderstatus as result, o_custkey as matter from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""


def ballots(spark: SparkSession, sf: str) -> DataFrame:
    vote = F.when(F.col("l_returnflag") == "A", "Ja").when(F.col("l_returnflag") == "N", "Nej").when(F.col("l_linestatus") == "F", "Avstår").otherwise("Frånvarande")
    event = F.concat_ws(":", F.col("l_orderkey").cast("string"), "l_linestatus")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("seq"), F.col("l_suppkey").alias("name"), F.concat(F.lit("P"), (F.col("l_suppkey") % 7).cast("string")).alias("party"), vote.alias("vote"), event.alias("event"), F.col("l_partkey").alias("matter"))


BALLOTS = """ballots as (select l_orderkey as id, l_linenumber as seq, l_suppkey as name, 'P' || (l_suppkey % 7)::varchar as party,
  case when l_returnflag = 'A' then 'Ja' when l_returnflag = 'N' then 'Nej' when l_linestatus = 'F' then 'Avstår' else 'Frånvarande' end as vote,
  l_orderkey::varchar || ':' || l_linestatus as event, l_partkey as matter from lineitem)"""
TALLY = """count(*) as named, count(*) filter (vote = 'Ja') as yes, count(*) filter (vote = 'Nej') as no, count(*) filter (vote = 'Avstår') as abstain,
  count(*) filter (vote = 'Frånvarande') as absent, count(distinct event) as rounds"""
