"""A written index of texts' tokens, and searches that read only the postings of matching tokens (TXT-11, TXT-06)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.functions.text import likely_token, normalize_query, normalize_text, token_score
from rostra.operators import joins

#: Characters at a text's start within which the place of a phrase counts; later places score alike.
LEAD = 160
#: Matching tokens that enter the scan of postings as a filter; more are joined.
FEW_TOKENS = 200
#: Matching tokens that are broadcast, at most: some 10 MB.
MANY_TOKENS = 100_000
#: Parts of a query that are scored token by token, at most.
MOST_PARTS = 6


def write_index(df: DataFrame, key: str, text: str, path: str, keep: Sequence[str] = ()) -> str:
    """Writes ``postings`` and ``tokens`` of normalised texts below ``path``, and returns it.

    Postings (token, id, keep, word, at, size): one for each word; ``word`` is its number, ``at`` its first character up to
    LEAD, ``size`` the text's length. Texts are dealt over tasks by key, and each task sorts the words of its own by token, so
    that scans skip the pages of other tokens in each file, and a token that is in every text is in every file. Texts are
    shuffled, once, and their words never. Tokens (token, n): each with its count. Null and blank texts have no postings; rows
    of one key are told apart by nothing and count as one text.
    """
    rows = joins.spread(df.select(F.col(key).alias("id"), *keep, F.col(text).alias("x")), "id").select("id", *keep, normalize_text(F.col("x")).alias("t"))
    # the outer form adds no filter, which would normalise each text twice
    each = rows.select("id", *keep, F.length("t").alias("size"), F.substring("t", 1, LEAD).alias("lead"), F.posexplode_outer(F.split("t", " ")).alias("word", "token")).where("token <> ''")
    # a word of at least one letter and a blank: later ones begin beyond LEAD
    at = F.when(F.col("word") == 0, 0).when(F.col("word") <= LEAD // 2, F.least(F.length(F.call_function("substring_index", "lead", F.lit(" "), F.col("word"))) + 1, F.lit(LEAD))).otherwise(LEAD)
    each.select("token", "id", *keep, "word", at.alias("at"), "size").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/postings")
    df.sparkSession.read.parquet(f"{path}/postings").groupBy("token").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/tokens")
    return path


def matching_tokens(spark: SparkSession, path: str, parts: Sequence[str]) -> DataFrame:
    """(part, token, score) of known tokens that score for parts of a query; words are compared here, once each, and not in texts."""
    known, out = spark.read.parquet(f"{path}/tokens").select("token"), None
    for i, p in enumerate(parts):
        found = known.where(likely_token(p, F.col("token"))).select(F.lit(i).alias("part"), "token", token_score(p, F.col("token")).alias("score")).where("score > 0")
        out = found if out is None else out.unionByName(found)
    return out


def matching_postings(postings: DataFrame, matched: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Postings with (part, best) for each part of a query that their token scores for. None is shuffled: matching tokens are
    broadcast, and where there are more than MANY_TOKENS, the token is scored in the posting."""
    few = [r.token for r in matched.select("token").distinct().limit(FEW_TOKENS + 1).collect()]
    if len(few) <= FEW_TOKENS:
        postings = postings.where(F.col("token").isin(few))
    elif matched.limit(MANY_TOKENS + 1).count() > MANY_TOKENS:
        scores = [F.when(likely_token(p, F.col("token")), token_score(p, F.col("token"))).otherwise(0) for p in parts]
        return postings.select("*", F.posexplode(F.array(*scores)).alias("part", "best")).where("best > 0")
    return postings.join(F.broadcast(matched.withColumnRenamed("score", "best")), "token")


def search(spark: SparkSession, path: str, query: str, key: str = "id", keep: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """(key, keep, score) of texts that score for a query, equal to ``field_score``; ``where`` is a condition on ``keep``.

    Tokens are matched first; only the postings of those are read. A text's score is its best token for each part, or the
    phrase's place: a part ends a word, the next ones are words, and the last begins one. An empty query finds nothing.
    """
    parts = normalize_query(query).split()
    postings = spark.read.parquet(f"{path}/postings")
    if not parts:
        return postings.select(F.col("id").alias(key), *keep, F.lit(0).alias("score")).limit(0)
    q, m = " ".join(parts), len(parts)
    held = postings if where is None else postings.where(where)
    hits = matching_postings(held, matching_tokens(spark, path, parts), parts)
    first, last = F.col("part") == 0, F.col("part") == m - 1
    p = F.get(F.array(*map(F.lit, parts)), F.col("part"))
    inner = F.when(F.lit(m == 1), F.instr("token", parts[0]) - 1).when(first, F.length("token") - F.length(p)).otherwise(0)
    fits = F.when(F.lit(m == 1), F.contains("token", p)).when(first, F.endswith("token", p)).when(last, F.startswith("token", p)).otherwise(F.col("token") == p)
    of_part = lambda i: F.max(F.when(F.col("part") == i, F.col("best")))
    if m == 1:
        each = hits.groupBy("id", *keep, "size").agg(F.max("best").alias("total"), F.min(F.when(fits, F.col("at") + inner)).alias("at"))
    else:
        # null unless every part has a token
        best = hits.groupBy("id", *keep, "size").agg(reduce(add, map(of_part, range(m))).alias("total"))
        runs = hits.where(fits).select("id", (F.col("word") - F.col("part")).alias("begins"), "part", F.when(first, F.col("at") + inner).alias("at"))
        whole = runs.groupBy("id", "begins").agg(*[F.bool_or(F.col("part") == i).alias(f"has{i}") for i in range(m)], F.min("at").alias("at")).where(reduce(and_, [F.col(f"has{i}") for i in range(m)]))
        each = best.join(whole.groupBy("id").agg(F.min("at").alias("at")), "id", "left")
    phrase = F.when(F.col("at") == 0, 900).when(F.col("at") > 0, 780 - F.least("at", F.lit(LEAD))).otherwise(0)
    same = F.coalesce((F.col("at") == 0) & (F.col("size") == len(q)), F.lit(False))
    total = F.coalesce(220 + F.col("total"), F.lit(0))
    score = F.greatest(phrase, total) if m <= MOST_PARTS else F.when(F.col("at").isNotNull(), 700).otherwise(0)
    return each.select(F.col("id").alias(key), *keep, F.when(same, 1000).otherwise(score).cast("int").alias("score")).where("score > 0")
