"""Operator 11: a Merkle manifest of a dataset, with proofs, by mountain-range stacks over indexed partitions."""

from __future__ import annotations

from binascii import hexlify, unhexlify
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostra.llm.common import release_memory, table, written

#: Nodes of a run that become one.
FANOUT = 2
#: Leaves of a partition, about; a task holds those of one at a time.
PART_LEAVES = 1 << 16
#: Levels above a partition's that the first merge takes in one group, and that each further merge does. A group gets the peaks of FANOUT ** RISE partitions.
RISE = 8
#: Bits of a row's number within its partition in Spark's increasing ids.
ROW_BITS = 33


def digest(nodes: list[bytes]) -> bytes:
    """H of a run: hexadecimal digests, hashed as text."""
    return sha256(b"".join(nodes)).hexdigest().encode()


def counts(leaves: int, fanout: int) -> list[int]:
    """Nodes of each level, up to the single one."""
    out = [leaves]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


class Range:
    """A mountain range: neighbouring nodes of one tree, those of complete runs replaced by what they become.

    A run is complete when it is full or ends the level, so the last runs need no padding. Where the first nodes do not begin
    a run, they stay as peaks of their own, as do the last ones; who has the neighbours merges them.
    """

    def __init__(self, leaves: int, fanout: int = FANOUT):
        self.fanout, self.counts = fanout, counts(leaves, fanout)
        self.peaks: list[tuple[int, int, bytes]] = []
        #: Of each node made here: its children's digests.
        self.made: dict[tuple[int, int], list[bytes]] = {}

    def push(self, level: int, index: int, node: bytes) -> None:
        """Adds the node to the right, and carries."""
        f, peaks = self.fanout, self.peaks
        peaks.append((level, index, node))
        while self.counts[level] > 1 and (index % f == f - 1 or index == self.counts[level] - 1):
            need = index % f + 1
            if len(peaks) < need or peaks[-need][:2] != (level, index - need + 1):
                return
            run = [p[2] for p in peaks[-need:]]
            del peaks[-need:]
            level, index = level + 1, index // f
            self.made[level, index] = run
            peaks.append((level, index, digest(run)))

    def step(self, level: int, index: int) -> bytes | None:
        """The part of a path that leads from a node to the one above it: place, size of the run, the others' digests. None at a peak."""
        run = self.made.get((level + 1, index // self.fanout))
        at = index % self.fanout
        return None if run is None else bytes([at, len(run)]) + unhexlify(b"".join(run[:at] + run[at + 1 :]))

    def path(self, level: int, index: int) -> tuple[bytes, int, int]:
        """(path, level, index) from a node up to the peak above it."""
        steps = []
        while (s := self.step(level, index)) is not None:
            steps.append(s)
            level, index = level + 1, index // self.fanout
        return b"".join(steps), level, index


def siblings(path: bytes) -> list[tuple[int, list[bytes]]]:
    """(place, hexadecimal digests of the others) of each level of a path."""
    out, i = [], 0
    while i < len(path):
        at, n = path[i], path[i + 1] - 1
        others = hexlify(path[i + 2 : i + 2 + 32 * n])
        out.append((at, [others[64 * j : 64 * j + 64] for j in range(n)]))
        i += 2 + 32 * n
    return out


def folded(leaf: bytes, levels: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf and the others of its path give."""
    for at, others in levels:
        leaf = digest([*others[:at], leaf, *others[at:]])
    return leaf


def field(name: str, value: Column | None = None) -> Column:
    text = (F.col(f"`{name}`") if value is None else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def ranges(leaves: pa.Table, more: pa.Table, fanout: int):
    """(run, leaves' places in the table, Range) of each group in a partition."""
    places = leaves.column("row").to_numpy().argsort(kind="stable")
    digests = leaves.column("leaf").to_pylist()
    for r in more.sort_by("first").to_pylist():
        if r["n"] is not None:
            made, mine = Range(r["total"], fanout), places[r["first"] : r["first"] + r["n"]].tolist()
            for i, at in enumerate(mine, r["before"]):
                made.push(0, i, hexlify(digests[at]))
            yield r, mine, made


RIGHT = "part int, g string, first bigint, n bigint, before bigint, total bigint, root binary, level int, idx bigint, path binary"


class Forest:
    """Trees over the leaves of each group: (g, key, leaf, other), ``leaf`` a binary digest, ``g`` not null; ordered by key, null first, then leaf.

    Leaves are range-partitioned and numbered, so that each partition knows the indices of its leaves from sizes alone. Each
    partition's stack leaves peaks; peaks are merged by regions of leaves that grow from round to round, and paths are put together downwards.
    """

    def __init__(self, leaves: DataFrame, fanout: int = FANOUT):
        if not 2 <= fanout <= 255:
            raise ValueError("a run has 2 to 255 nodes")
        spark, self.fanout = leaves.sparkSession, fanout
        held = written(leaves)
        n = held.count()
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PART_LEAVES))
        # rows that agree in all are told apart by where they are stored
        order = ["g", F.asc_nulls_first("key"), "leaf", "file", "at"]
        placed = held.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
        sorted_ = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        number = F.monotonically_increasing_id()
        self.rows = written(sorted_.select(number.alias("number"), "g", "key", "leaf", "other")).select(
            F.shiftright("number", ROW_BITS).cast("int").alias("part"), F.col("number").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("row"), "g", "key", "leaf", "other"
        )
        by_group = W.partitionBy("g")
        before = F.coalesce(F.sum("n").over(by_group.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        sizes = self.rows.groupBy("part", "g").agg(F.min("row").alias("first"), F.count("*").alias("n"))
        self.runs = written(sizes.select("part", "g", "first", "n", before.alias("before"), F.sum("n").over(by_group).alias("total")))

    def per_part(self, right: DataFrame, function, kinds: str) -> DataFrame:
        def run(leaves, more):
            out = function(leaves, more)
            release_memory()
            return out

        return self.rows.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(run, kinds)

    def nodes(self) -> DataFrame:
        """(part, g, level, idx, digest, peak): what each partition's stack made, and which of it stayed."""
        fanout = self.fanout

        def stack(leaves, more):
            out = {c: [] for c in ("part", "g", "level", "idx", "digest", "peak", "total")}
            for r, _, made in ranges(leaves, more, fanout):
                tops = {(k, i): d for k, i, d in made.peaks}
                for (k, i), d in {**{key: digest(run) for key, run in made.made.items()}, **tops}.items():
                    for c, v in zip(out, (r["part"], r["g"], k, i, unhexlify(d), (k, i) in tops, r["total"])):
                        out[c].append(v)
            return pa.table(out, schema=pa.schema([("part", pa.int32()), ("g", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.binary()), ("peak", pa.bool_()), ("total", pa.int64())]))

        return self.per_part(self.runs, stack, "part int, g string, level int, idx bigint, digest binary, peak boolean, total bigint")

    def merged(self) -> tuple[DataFrame, DataFrame]:
        """((part, g, level, idx, path) of each partition's peaks, (g, digest, total) of each group): paths lead to the groups' roots."""
        spark, fanout = self.rows.sparkSession, self.fanout
        nodes = written(self.nodes().where("peak"))
        most = nodes.agg(F.max("total")).head()[0] or 0
        levels, rise = len(counts(most, fanout)) - 1, RISE + len(counts(PART_LEAVES, fanout)) - 1
        kinds = "g string, level int, idx bigint, path binary, up_level int, up_idx bigint, up_digest binary, total bigint"

        def merge(rows: pa.Table) -> pa.Table:
            peaks = sorted(rows.to_pylist(), key=lambda r: r["idx"] * fanout ** r["level"])
            made = Range(peaks[0]["total"], fanout)
            for p in peaks:
                made.push(p["level"], p["idx"], hexlify(p["digest"]))
            tops = {(k, i): unhexlify(d) for k, i, d in made.peaks}
            ways = [made.path(p["level"], p["idx"]) for p in peaks]
            columns = [[p["g"] for p in peaks], [p["level"] for p in peaks], [p["idx"] for p in peaks], *zip(*ways), [tops[w[1:]] for w in ways], [p["total"] for p in peaks]]
            return pa.table([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int64()))], names=[k.split()[0] for k in kinds.split(", ")])

        now, rounds, at = nodes.select("g", "level", "idx", "digest", "total"), [], rise
        while True:
            spread = F.expr(f"idx div cast(power({fanout}, greatest(0, {min(at, levels)} - level)) as bigint)")
            region = F.when(F.col("level") >= min(at, levels), F.expr(f"idx * cast(power({fanout}, level - {min(at, levels)}) as bigint)")).otherwise(spread)
            rounds.append(written(now.withColumn("region", region).groupBy("g", "region").applyInArrow(merge, kinds)))
            now = rounds[-1].select("g", F.col("up_level").alias("level"), F.col("up_idx").alias("idx"), F.col("up_digest").alias("digest"), "total").distinct()
            if at >= levels:
                break
            at += RISE
        roots = written(now.select("g", "digest", "total"))
        paths = rounds[-1].select("g", "level", "idx", "path")
        for r in reversed(rounds[:-1]):
            above = paths.select(F.col("g").alias("g2"), F.col("level").alias("up_level"), F.col("idx").alias("up_idx"), F.col("path").alias("rest"))
            paths = r.join(above, (F.col("g") == F.col("g2")) & (r["up_level"] == above["up_level"]) & (r["up_idx"] == above["up_idx"])).select("g", "level", "idx", F.concat("path", "rest").alias("path"))
        own = nodes.select("part", "g", "level", "idx").join(paths, ["g", "level", "idx"])
        return written(own.select("part", "g", "level", "idx", "path")), roots

    def with_paths(self, paths: DataFrame, roots: DataFrame, function, kinds: str) -> DataFrame:
        """What ``function`` gives for (leaves, place in them, path to the last root, group's root) of every leaf, as rows of ``kinds``."""
        runs = self.runs.join(roots.select("g", F.col("digest").alias("root")), "g")
        empty = {k.split()[0]: F.lit(None).cast(k.split()[1]) for k in RIGHT.split(", ")}
        right = runs.select(*[F.col(c) if c in runs.columns else x.alias(c) for c, x in empty.items()]).unionByName(paths.select(*[F.col(c) if c in paths.columns else x.alias(c) for c, x in empty.items()]))
        fanout = self.fanout
        names = [k.split()[0] for k in kinds.split(", ")]

        def prove(leaves, more):
            ways = {(r["g"], r["level"], r["idx"]): r["path"] for r in more.to_pylist() if r["path"] is not None}
            data, out = {c: leaves.column(c).to_pylist() for c in ("key", "leaf", "other")}, []
            for r, mine, made in ranges(leaves, more, fanout):
                known = {(k, i): siblings(ways[r["g"], k, i]) for k, i, _ in made.peaks}
                for level, index in sorted((key for key in made.made if key[0] > 1), reverse=True):  # downwards: what leads up from each node
                    for i in range(index * fanout, index * fanout + len(made.made[level, index])):
                        known[level - 1, i] = [*siblings(made.step(level - 1, i)), *known[level, index]]
                for i, at in enumerate(mine, r["before"]):
                    s = made.step(0, i)
                    levels = known[0, i] if s is None else [*siblings(s), *known[1, i // fanout]]
                    out.append(function({c: v[at] for c, v in data.items()}, levels, r["root"]))
            return pa.table({c: [row[j] for row in out] for j, c in enumerate(names)}, schema=pa.schema([(k.split()[0], {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[k.split()[1]]) for k in kinds.split(", ")]))

        return self.per_part(right, prove, kinds)


def packed(levels: list[tuple[int, list[bytes]]]) -> bytes:
    return b"".join(bytes([at, len(others) + 1]) + unhexlify(b"".join(others)) for at, others in levels)


def manifest(df: DataFrame, changed: Column, fields=("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "lang", id_col: str = "doc_id", count_col: str = "n_chars", fanout: int = FANOUT) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    A leaf hashes the row's fields. Each group's leaves, by id, become a tree, and the groups' roots, by group (null first,
    bytewise), another one. ``proof_sha256`` hashes the others on a leaf's way up; ``folded_root`` is what they give with the
    leaf, or with the one of a row where ``changed`` holds, whose ``count_col`` is raised by 1.

    Only ids and digests are shuffled. A partition's task holds about PART_LEAVES of them, a merge's the peaks of some
    hundred partitions; groups of any size are cut by ranges, and nothing but sizes meets in a task or the driver.

    Nulls: a field is ``-``; a null group is one group, a null id comes first, and stays untampered. Ties of id: by leaf. Equal
    rows: each is a leaf. Empty and very long texts are hashed whole. One row: leaf, subroot and root are the same, and the
    proof hashes nothing. Empty table: no rows. Other columns are not read.
    """
    spark = df.sparkSession
    more = F.coalesce(changed & F.col(f"`{count_col}`").isNotNull(), F.lit(False))
    raised = F.col(f"`{count_col}`").cast("decimal(38,0)") + 1
    hashed = lambda c: F.unhex(F.sha2(F.concat(*[field(x, c if x == count_col else None) for x in fields]), 256))
    group = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    leaves = df.select(group.alias("g"), F.col(f"`{id_col}`").cast("bigint").alias("key"), hashed(None).alias("leaf"), F.when(more, hashed(raised)).alias("other"))
    first = Forest(leaves, fanout)
    kinds = f"{id_col} bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    paths, roots = first.merged()
    second = Forest(roots.select(F.lit("").alias("g"), F.col("g").alias("key"), F.col("digest").alias("leaf"), F.lit(None).cast("binary").alias("other")), fanout)
    top_paths, top = second.merged()
    found = top.head()
    if found is None:
        return spark.createDataFrame([], kinds)
    rest = second.with_paths(top_paths, top, lambda leaf, levels, _: (leaf["key"], packed(levels)), "key string, rest binary")
    whole = written(paths.join(rest, paths["g"] == rest["key"]).select("part", "g", "level", "idx", F.concat("path", "rest").alias("path")))
    root = found["digest"].hex().encode()

    def proof(leaf, levels, subroot):
        end = folded(hexlify(leaf["other"] or leaf["leaf"]), levels)
        return leaf["key"], leaf["leaf"].hex(), subroot.hex(), root.decode(), digest([x for _, others in levels for x in others]).decode(), end.decode(), end == root

    return first.with_paths(whole, roots, proof, kinds)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    return manifest(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 0)


_FIELD = "coalesce(octet_length(encode({0}))::varchar || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(x) for x in ("doc_id::varchar", "source", "lang", "{n}", "text")) + ")"
OP11_SQL = f"""
with recursive d as (
  select doc_id, coalesce('=' || lang, '') as g, {_LEAF.format(n="n_chars::varchar")} as leaf, {_LEAF.format(n="(n_chars + 1)::varchar")} as raised,
         xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda r, i: case when r & 1 = 1 then xor(r >> 1, 3988292384::bigint) else r >> 1 end))) as crc
  from documents),
l as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as n, row_number() over () as own from d),
nodes as (
  select g, 0 as k, i, n, leaf as h from l
  union all
  select g, k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from nodes where n > 1 group by g, k, i // 2, n),
r as (select g, h, row_number() over (order by g) - 1 as i, count(*) over () as n from nodes where n = 1),
tops as (
  select 0 as k, i, n, h from r
  union all
  select k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from tops where n > 1 group by k, i // 2, n),
levels as (select distinct g, k from nodes where n > 1),
steps as (
  select l.own, 0 as t, v.k, case when s.h is null then '' when (l.i >> v.k) & 1 = 1 then 'L' || s.h else 'R' || s.h end as s
  from l join levels v using (g) left join nodes s on s.g = l.g and s.k = v.k and s.i = xor(l.i >> v.k, 1)
  union all
  select l.own, 1, v.k, case when s.h is null then '' when (r.i >> v.k) & 1 = 1 then 'L' || s.h else 'R' || s.h end
  from l join r using (g) cross join (select distinct k from tops where n > 1) v left join tops s on s.k = v.k and s.i = xor(r.i >> v.k, 1)),
p as (select own, list(s order by t, k) as s, string_agg(substr(s, 2), '' order by t, k) as others from steps group by own),
f as (select l.doc_id, l.leaf, r.h as subroot, (select h from tops where n = 1) as root, sha256(coalesce(p.others, '')) as proof_sha256,
       list_reduce(list_prepend(case when l.crc % 7 = 0 then coalesce(l.raised, l.leaf) else l.leaf end, coalesce(p.s, [])),
         lambda a, s: sha256(case when s = '' then a when s[1] = 'L' then s[2:] || a else a || s[2:] end)) as folded_root
      from l join r using (g) left join p using (own))
select *, folded_root = root as verified from f
"""
