"""Operator 6: chat formatting by perspective rotation, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostra.llm.common import table, written

#: Turns of a rendered part; dialogues with more continue in the next part.
PART_TURNS = 256
#: Speakers that take no part in the rotation.
SYSTEM = "system"
TAIL = "<|im_end|>\n"


def harmless(text: Column) -> Column:
    """The text without markers of its own: ``<|im_`` becomes ``<\\|im_``."""
    return F.replace(text, F.lit("<|im_"), F.lit("<\\|im_"))


OWN = "<|im_start|>assistant\n"


def other_head(speaker: Column) -> Column:
    """What stands before the text of a system turn or of a user, who is named if the speaker has a name."""
    named = F.concat(F.lit("<|im_start|>user name="), F.translate(harmless(speaker), "\r\n", "  "), F.lit("\n"))
    return F.when(speaker.isNull(), F.lit("<|im_start|>user\n")).when(speaker == SYSTEM, F.lit("<|im_start|>system\n")).otherwise(named)


def with_parts(rows: DataFrame, part_turns: int) -> DataFrame:
    """Distinct rows (conv, turn, who, said) with ``part``: the number of rows before in the dialogue, by part_turns.

    Rows are range-partitioned and numbered by position; only partitions' sizes meet in one place, so no task holds a dialogue.
    """
    by = ["conv", "turn", "who", "said"]
    placed = written(rows.repartitionByRange(*by).dropDuplicates(by).sortWithinPartitions(*by).withColumn("pos", F.monotonically_increasing_id()))
    slot = F.shiftright("pos", 33)
    sizes = placed.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"))
    before = sizes.select("slot", F.coalesce(F.sum("n").over(W.orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = placed.join(F.broadcast(before), slot == before.slot).withColumn("n", F.col("before") + F.col("pos") - F.shiftleft("slot", 33))
    first = numbered.groupBy("conv").agg(F.min("n").alias("first"))
    return numbered.join(first, "conv").select(*by, F.floor((F.col("n") - F.col("first")) / part_turns).alias("part"))


def rotate(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """(conv, perspective, part, start, n_turns, n_chars, n_masked, rendered, masks): the dialogue from every participant's seat.

    In ``rendered`` the participant's own turns are the assistant's, those of others are users' with names, and system turns
    stay. ``masks`` are the character spans [begin, end) of the assistant's texts and their end marks: what a model is
    trained on. A dialogue of more than ``part_turns`` turns is stored in parts: its rendering is that of its parts, one
    after another, ``start`` is where a part begins in it, and ``masks`` count from the dialogue's start. So neither text nor
    spans depend on the parts, and no task gathers a dialogue.

    Null conversation or turn: the row is left out, as it has no place. Null role: a user without name, and a participant
    (null perspective) of its own. Null text: empty. Markers in texts and roles are defused (``harmless``), line breaks in
    roles become blanks. Repeated rows: rendered once. Rows with one turn number: in order of role, then text. A
    conversation of system turns only has no participant and no rows. Very long text: taken whole. Empty table: no rows.
    Other columns are not read.
    """
    rows = with_parts(
        df.where(F.col(conv).isNotNull() & F.col(turn).isNotNull()).select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("who"), harmless(F.coalesce(text, F.lit(""))).alias("said")),
        part_turns,
    )
    # where each part begins from each seat, from lengths alone
    seen = rows.groupBy("conv", "part", F.col("who").alias("seat")).agg(F.count("*").alias("own"), F.sum(F.length(other_head(F.col("who"))) + F.length("said") + len(TAIL)).alias("chars"))
    sizes = seen.groupBy("conv", "part").agg(F.sum("chars").alias("chars"))
    talks = seen.where(~F.col("seat").eqNullSafe(F.lit(SYSTEM)))
    seats = talks.select("conv", "seat").distinct()
    own = talks.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.col("seat").alias("s"), "own")
    every = sizes.join(seats, "conv").join(own, (F.col("conv") == F.col("c")) & (F.col("part") == F.col("p")) & F.col("seat").eqNullSafe(F.col("s")), "left")
    change = len(OWN) - F.length(other_head(F.col("seat")))
    upto = every.select("conv", "part", "seat", (F.col("chars") + F.coalesce("own", F.lit(0)) * change).alias("n_chars"))
    before = W.partitionBy("conv", "seat").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    places = upto.withColumn("start", F.coalesce(F.sum("n_chars").over(before), F.lit(0)))
    parts = rows.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "who", "said"))).alias("t"))
    seated = parts.join(places, ["conv", "part"])
    # each turn as (head, body with end mark, whether it is the seat's own)
    pieces = F.transform("t", lambda x: F.struct(F.concat(x["said"], F.lit(TAIL)).alias("b"), x["who"].eqNullSafe(F.col("seat")).alias("own"), x["who"].alias("who")))
    pieces = F.transform(pieces, lambda x: F.struct(F.when(x["own"], F.lit(OWN)).otherwise(other_head(x["who"])).alias("h"), x["b"].alias("b"), x["own"].alias("own")))
    kept = seated.select("conv", "seat", "part", "start", "n_chars", pieces.alias("p"))
    zero = F.struct(F.col("start").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("m"))
    end = lambda a, x: a["at"] + F.length(x["h"]) + F.length(x["b"])
    spans = F.aggregate("p", zero, lambda a, x: F.struct(end(a, x).cast("bigint").alias("at"), F.when(x["own"], F.concat(a["m"], F.array(F.struct((a["at"] + F.length(x["h"])).cast("bigint").alias("begin"), end(a, x).cast("bigint").alias("end"))))).otherwise(a["m"]).alias("m")))
    out = kept.select(
        F.col("conv").alias(conv), F.col("seat").alias("perspective"), "part", "start", F.size("p").cast("bigint").alias("n_turns"), "n_chars",
        F.array_join(F.transform("p", lambda x: F.concat(x["h"], x["b"])), "").alias("rendered"), spans["m"].alias("masks"),
    )
    masked = F.aggregate("masks", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["begin"])
    return out.select(conv, "perspective", "part", "start", "n_turns", "n_chars", masked.alias("n_masked"), "rendered", "masks")


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("masks", lambda x: F.concat(x["begin"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    return rotate(table(spark, sf_dir, "conversations")).withColumn("masks", spans)


OP6_SQL = r"""
with r as (select distinct conv_id, turn, role as who, replace(coalesce(text, ''), '<|im_', '<\|im_') as said from conversations where conv_id is not null and turn is not null),
n as (select *, (row_number() over (partition by conv_id order by turn, who nulls first, said) - 1) // 256 as part from r),
s as (select distinct conv_id, who as seat from r where who is distinct from 'system'),
p as (select n.conv_id, s.seat as perspective, part, turn, who, said, who is not distinct from seat as own,
        case when who is not distinct from 'system' then '<|im_start|>system' || chr(10) when who is not distinct from seat then '<|im_start|>assistant' || chr(10)
             when who is null then '<|im_start|>user' || chr(10) else '<|im_start|>user name=' || translate(replace(who, '<|im_', '<\|im_'), chr(13) || chr(10), '  ') || chr(10) end as h,
        said || '<|im_end|>' || chr(10) as b from n join s using (conv_id)),
o as (select *, sum(length(h) + length(b)) over (partition by conv_id, perspective order by turn, who nulls first, said rows unbounded preceding) as e from p)
select conv_id, perspective, part, cast(min(e - length(h) - length(b)) as bigint) as start, count(*) as n_turns, cast(sum(length(h) + length(b)) as bigint) as n_chars,
       cast(coalesce(sum(length(b)) filter (own), 0) as bigint) as n_masked, string_agg(h || b, '' order by turn, who nulls first, said) as rendered,
       coalesce(string_agg((e - length(b))::bigint::varchar || '-' || e::bigint::varchar, ',' order by turn, who nulls first, said) filter (own), '') as masks
from o group by conv_id, perspective, part
"""
