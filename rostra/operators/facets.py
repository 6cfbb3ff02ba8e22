"""Faceted filters: OR within a facet, AND across facets, an empty facet restricts nothing."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.operators.joins import unused

#: Codes of ballots that count for no party. Fixed values.
INVALID_CODES = ("BLANK", "OG", "OGEJ")
PUBLIC_SINCE = "2023-01-01"


@dataclass(frozen=True)
class FacetSpec:
    """A request: allowed values by column, and inclusive date ranges on ``date_col``."""

    values: Mapping[str, Sequence] = field(default_factory=dict)
    ranges: Sequence[tuple[str, str]] = ()
    date_col: str = "date"

    def predicate(self) -> Column:
        return facet_predicate(self.values) & in_ranges(F.col(self.date_col), self.ranges)


def facet_predicate(values: Mapping[str, Sequence]) -> Column:
    return reduce(and_, [F.col(c).isin(list(v)) for c, v in values.items() if len(v)], F.lit(True))


def date_ranges(pairs: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """Ranges with their ends in order, each once, sorted."""
    return sorted({tuple(sorted(p)) for p in pairs})


def in_ranges(col: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Inside any of the inclusive ranges; rows without date pass only if there is no range."""
    ranges = date_ranges(pairs)
    return F.coalesce(reduce(or_, [col.between(F.lit(a).cast("date"), F.lit(b).cast("date")) for a, b in ranges]), F.lit(False)) if ranges else F.lit(True)


def faceted(df: DataFrame, spec: FacetSpec) -> DataFrame:
    return df.where(spec.predicate())


def is_invalid(code: Column) -> Column:
    return code.isin(*INVALID_CODES)


def is_public(date_text: Column) -> Column:
    """Well-formed ISO dates since the cutoff."""
    return date_text.rlike(r"^20[0-9]{2}-[0-9]{2}-[0-9]{2}$") & (date_text >= PUBLIC_SINCE)


def facet_values(df: DataFrame, facets: Sequence[str]) -> DataFrame:
    """(facet, value, n): the values of each facet, spelled as they first sort, counted without regard to case.

    All facets are counted in one pass: rows are unpivoted and partially aggregated before the shuffle.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets])).alias("x")
    flat = df.select(pairs).select("x.facet", "x.value").where("value is not null and value <> ''")
    return flat.groupBy("facet", F.lower("value").alias("folded")).agg(F.min("value").alias("value"), F.count("*").alias("n")).select("facet", "value", "n")


def cascading_values(df: DataFrame, target: str, chosen: Mapping[str, Sequence]) -> DataFrame:
    """Values of one facet that occur under the choices made in the others."""
    others = {k: v for k, v in chosen.items() if k != target}
    return df.where(facet_predicate(others)).groupBy(target).agg(F.count("*").alias("n")).where(F.col(target).isNotNull())


def cascading_values_all(df: DataFrame, facets: Sequence[str], chosen: Mapping[str, Sequence]) -> DataFrame:
    """(facet, value, n): the values of every facet that occur under the choices made in the others, in one scan.

    Each row has a bit for each facet whose choice it fails. It counts for a facet if it fails none, or that one alone, so a
    row that fails two counts nowhere and goes before anything is shuffled. Nulls fail a choice, and are no values.
    """
    facets = list(facets)
    failed = reduce(lambda a, b: a.bitwiseOR(b), [F.when(~F.coalesce(F.col(f).isin(list(chosen[f])), F.lit(False)), F.lit(1 << i).cast("bigint")).otherwise(0) for i, f in enumerate(facets) if len(chosen.get(f, ()))], F.lit(0).cast("bigint"))
    others = [c for c in chosen if c not in facets and len(chosen[c])]
    bits = unused(df.columns, "failed")
    held = df.where(facet_predicate({c: chosen[c] for c in others})).select(*[F.col(f).cast("string").alias(f) for f in facets], failed.alias(bits)).where(F.bit_count(bits) <= 1)
    counts = lambda i: F.col(bits).bitwiseAND(F.lit(((1 << len(facets)) - 1) ^ (1 << i)).cast("bigint")) == 0
    pairs = F.array_compact(F.array(*[F.when(counts(i) & F.col(f).isNotNull(), F.struct(F.lit(f).alias("facet"), F.col(f).alias("value"))) for i, f in enumerate(facets)]))
    return held.select(F.explode(pairs).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))
