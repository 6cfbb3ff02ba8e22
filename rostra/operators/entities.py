"""People: cleaned names, aliases within a party, and an index by surname."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostra.functions.keys import squeezed, text_or_empty
from rostra.functions.text import fold
from rostra.operators.joins import unused


#: Words with which a note begins that is no name, words before a name, and one after it. Fixed values.
NO_NAME, BEFORE_NAME, AFTER_NAME = r"(?i)^(?:ersätter|ersättare för|tjänstgör för|frånvarande)\b", r"(?i)^(?:jäv|ordförande)\s+", r"(?i)\s*,\s*politisk\s+sekreterare\s*$"


def person_name(col: Column) -> Column:
    """A name without a date or a role before it, with single blanks and plain hyphens; empty where a note stands in its place."""
    plain = squeezed(F.regexp_replace(F.regexp_replace(text_or_empty(col), r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}\s+", ""), "[‐‑–—]", "-"))
    bare = F.trim(F.regexp_replace(F.regexp_replace(plain, BEFORE_NAME, ""), AFTER_NAME, ""))
    return F.when(plain.rlike(NO_NAME), "").otherwise(bare)


def person_key(col: Column) -> Column:
    """The name in lower case, hyphens as blanks, without accents; ø as o and æ as ae."""
    folded = fold(squeezed(F.replace(F.lower(person_name(col)), F.lit("-"), F.lit(" "))))
    return squeezed(F.regexp_replace(F.replace(F.translate(folded, "ø", "o"), F.lit("æ"), F.lit("ae")), "[^a-z0-9 ]", ""))


def reviewed(people: DataFrame, aliases: DataFrame, party: str, name: str) -> DataFrame:
    """Names by the reviewed table (party, alias, canonical), matched by key within the party; others stay. The first of several wins."""
    of, key, stands = (unused(people.columns, c) for c in ("of_party", "by_key", "stands"))
    by = aliases.groupBy(F.col("party").alias(of), person_key(F.col("alias")).alias(key)).agg(F.min("canonical").alias(stands))
    found = people.join(by, (F.col(party) == F.col(of)) & (person_key(F.col(name)) == F.col(key)), "left")
    return found.select(*[F.coalesce(stands, name).alias(c) if c == name else F.col(c) for c in people.columns])


def deletions(col: Column) -> Column:
    """The text and all texts with one character less: two texts one edit apart share one of these."""
    cut = lambda i: F.concat(F.substr(col, F.lit(1), i - 1), F.substr(col, i + 1, F.length(col)))
    return F.array_distinct(F.concat(F.array(col), F.when(F.length(col) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(col), F.lit(1))), cut)).otherwise(F.array().cast("array<string>"))))


def alias_pairs(people: DataFrame, party: str, name: str) -> DataFrame:
    """(party, a, b) with a < b and at most one edit between: joined by equality on shared deletions, never pair by pair."""
    each = people.select(party, name).distinct().withColumn("d", F.explode(deletions(F.col(name))))
    left, right = each.withColumnRenamed(name, "a"), each.withColumnRenamed(name, "b")
    return left.join(right, [party, "d"]).where((F.col("a") < F.col("b")) & F.levenshtein("a", "b", 1).between(0, 1)).select(party, "a", "b").distinct()


def automatic_aliases(people: DataFrame, party: str, name: str, count: str) -> DataFrame:
    """(party, alias, canonical): of each pair the more frequent spelling stands, ties to more accents, then hyphens, then
    length, then the smaller; a name's last pair counts."""
    marks = lambda c: F.length(F.regexp_replace(c, "[\\x00-\\x7F]", ""))
    hyphens = lambda c: F.length(c) - F.length(F.replace(c, F.lit("-"), F.lit("")))
    rank = lambda c, n: F.struct(n, marks(c), hyphens(c), F.length(c))
    counts = people.groupBy(party, name).agg(F.sum(count).alias("n"))
    pairs = alias_pairs(counts, party, name)
    pairs = pairs.join(counts.select(party, F.col(name).alias("a"), F.col("n").alias("na")), [party, "a"]).join(counts.select(party, F.col(name).alias("b"), F.col("n").alias("nb")), [party, "b"])
    a_wins = rank(F.col("a"), F.col("na")) >= rank(F.col("b"), F.col("nb"))
    made = pairs.select(party, "a", "b", F.when(a_wins, F.col("b")).otherwise(F.col("a")).alias("alias"), F.when(a_wins, F.col("a")).otherwise(F.col("b")).alias("canonical"))
    return made.groupBy(party, "alias").agg(F.max_by("canonical", F.struct("a", "b")).alias("canonical"))


def person_index(people: DataFrame, party: str, body: str, name: str) -> DataFrame:
    """(party, body, surname, name): the one person of a surname within party and body, else within the party; ambiguous surnames are left out."""
    words = people.select(party, body, F.col(name).alias("name"), F.element_at(F.split(name, " "), -1).alias("surname")).distinct()
    near = words.groupBy(party, body, "surname").agg(F.count_distinct("name").alias("n"), F.min("name").alias("near"))
    wide = words.groupBy(party, "surname").agg(F.count_distinct("name").alias("m"), F.min("name").alias("wide"))
    both = near.join(wide, [party, "surname"])
    return both.select(party, body, "surname", F.when(F.col("n") == 1, F.col("near")).when(F.col("m") == 1, F.col("wide")).alias("name")).where("name is not null")


def identities(people: DataFrame, party: str, body: str, name: str) -> DataFrame:
    """(party, body, name, norm, first, last, identity) of distinct named people; the identity is the first and last word, none for a single word."""
    rows = people.select(text_or_empty(F.col(party)).alias("party"), text_or_empty(F.col(body)).alias("body"), person_name(F.col(name)).alias("name"), person_key(F.col(name)).alias("norm"))
    words = F.split("norm", " ")
    first, last = F.get(words, F.lit(0)), F.get(words, F.size(words) - 1)
    known = rows.where("name <> '' and norm <> ''").distinct()
    return known.select("*", first.alias("first"), last.alias("last"), F.when(F.size(words) > 1, F.concat_ws("|", first, last)).alias("identity"))


def resolved_people(people: DataFrame, party: str, body: str, name: str) -> tuple[DataFrame, DataFrame]:
    """((party, body, norm, name, how), (party, norm, name)): whom each name means in a body, and in its party anywhere.

    A name of several words means its identity, in the identity's longest spelling (ties: the smaller key, then spelling). A
    single word means the one identity of that surname in its party and body; where the body knows none, the one in the
    party; else itself. In the party's map a name is blank where bodies disagree. ``how``: identity, body, party or own.

    Candidate sets are counts of distinct identities, so no surname's bearers are gathered.
    """
    known = identities(people, party, body, name)
    whole = known.where("identity is not null")
    spelt = whole.groupBy("party", "identity").agg(F.min_by("name", F.struct(-F.length("name"), F.col("norm"), F.col("name"))).alias("spelt"))
    near = whole.groupBy("party", "body", "last").agg(F.count_distinct("identity").alias("n"), F.min("identity").alias("near"))
    wide = whole.groupBy("party", "last").agg(F.count_distinct("identity").alias("m"), F.min("identity").alias("wide"))
    both = known.join(near, ["party", "body", "last"], "left").join(wide, ["party", "last"], "left")
    how = F.when(F.col("identity").isNotNull(), "identity").when(F.col("n") == 1, "body").when(F.col("n").isNull() & (F.col("m") == 1), "party").otherwise("own")
    meant = F.when(F.col("how") == "identity", F.col("identity")).when(F.col("how") == "body", F.col("near")).when(F.col("how") == "party", F.col("wide"))
    asked = both.withColumn("how", how).select("party", "body", "norm", "name", "how", meant.alias("identity"))
    found = asked.join(spelt, ["party", "identity"], "left").select("party", "body", "norm", F.coalesce("spelt", "name").alias("name"), "how")
    # spellings that share a key may differ where each stands for itself; the smaller one does for all
    by_body = found.groupBy("party", "body", "norm").agg(F.min("name").alias("name"), F.min("how").alias("how"))
    by_party = found.groupBy("party", "norm").agg(F.when(F.min("name") == F.max("name"), F.min("name")).otherwise("").alias("name"))
    return by_body, by_party


def preferred_spelling(people: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Each key's most frequent spelling; ties to the longer, then the smaller."""
    counts = people.groupBy(*keys, name).agg(F.count("*").alias("n"))
    order = W.partitionBy(*keys).orderBy(F.desc("n"), F.desc(F.length(name)), name)
    rank = unused(counts.columns, "rank")
    return counts.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)
