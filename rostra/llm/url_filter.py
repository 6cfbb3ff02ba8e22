"""Operator 2: URL filters by rules and link-graph propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.llm.common import table, written

#: Host and path prefix of each rule, and whether it allows.
RULES = (("com", "/", True), ("example.com", "/en/", False), ("www.example.com", "/en/", True), ("net", "/es/", False), ("net", "/fr/", False))
#: Change of all ranks of a kind over CHECK rounds at which rounds end, and rounds at most: 0.85 ** 128 is below the tolerance.
TOLERANCE, ROUNDS, CHECK, DAMPING = 1e-8, 132, 4, 0.85
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, allows) of the longest rule that fits, or null. A rule fits its host and all subdomains, and paths that begin with its own."""
    found = F.lit(None).cast("struct<rule:string,allows:boolean>")
    for h, p, allows in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):  # later ones are longer
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(allows).alias("allows"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(src, dst, n): links between different hosts, counted. Links without a host stay on their own and are none."""
    links = F.explode(F.regexp_extract_all(html, F.lit(r"""(?i)\shref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1)))
    seen = pages.where(F.col(host) != "").select(F.col(host).alias("src"), links.alias("link"))
    dst = F.translate(F.regexp_extract("link", r"^[^/]*//([^/?#]*)", 1), UPPER, LOWER)
    return seen.select("src", dst.alias("dst")).where("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust). Trust follows links from trusted hosts; distrust goes against links, from blocked hosts to those
    that link to them. Both are personalised PageRanks: each round passes ``damping`` of a host's rank on and gives the
    rest back to the seeds; what no link passes on goes back to the seeds too. Rounds end when the ranks of neither kind have
    changed by more than ``tolerance`` in all over the last CHECK rounds; each round changes them by ``damping`` times what
    the last one did, at most. Raises RuntimeError if ``rounds`` rounds are not enough.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    back = edges.groupBy("dst").agg(F.sum("n").alias("out"))
    forward = edges.join(out, "src").select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("n") / F.col("out")).alias("w"), F.lit("t").alias("kind"))
    against = edges.join(back, "dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), (F.col("n") / F.col("out")).alias("w"), F.lit("d").alias("kind"))
    moves = written(forward.union(against))
    sums = {r.kind: r.s for r in seeds.groupBy("kind").agg(F.sum("s").alias("s")).collect()}  # two numbers
    start = seeds.select("kind", "host", (F.col("s") / F.create_map(*[F.lit(x) for kv in (sums or {"-": 1.0}).items() for x in kv])[F.col("kind")]).alias("s"))
    start = written(start)
    if not moves.head(1):  # nothing to pass on
        return start.groupBy("host").pivot("kind", ["t", "d"]).agg(F.sum("s")).select("host", F.coalesce("t", F.lit(0.0)).alias("trust"), F.coalesce("d", F.lit(0.0)).alias("distrust"))
    mark = rank = start.withColumnRenamed("s", "r")
    for i in range(rounds):
        passed = moves.join(rank.withColumnRenamed("host", "a"), ["kind", "a"]).groupBy("kind", "b").agg(F.sum(F.col("w") * F.col("r") * damping).alias("r")).withColumnRenamed("b", "host")
        kept = passed.groupBy("kind").agg(F.sum("r").alias("held"))
        # two rows are broadcast
        again = start.join(F.broadcast(kept), "kind", "left").select("kind", "host", (F.col("s") * (1 - F.coalesce("held", F.lit(0.0)))).alias("r"))
        rank = passed.unionByName(again).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        if i % CHECK == CHECK - 1:
            rank = written(rank)
            both = rank.unionByName(mark.withColumn("r", -F.col("r"))).groupBy("kind", "host").agg(F.abs(F.sum("r")).alias("moved"))
            if max((r.m for r in both.groupBy("kind").agg(F.sum("moved").alias("m")).collect()), default=0.0) <= tolerance:  # two numbers
                break
            mark = rank
    else:
        raise RuntimeError(f"ranks did not settle within {rounds} rounds")
    return rank.groupBy("host").pivot("kind", ["t", "d"]).agg(F.sum("r")).select("host", F.coalesce("t", F.lit(0.0)).alias("trust"), F.coalesce("d", F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, tolerance: float = TOLERANCE, rounds: int = ROUNDS, most_distrust: float = 0.5) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict``, ``trust``, ``distrust``.

    A page that a rule fits has the rule's verdict. Hosts with allowed pages are trusted seeds and hosts with blocked pages
    are blocked seeds, each weighted by its share among the host's ruled pages; trust and reversed distrust spread over the
    links between hosts. Other pages are blocked if their host's distrust makes up more than ``most_distrust`` of its trust
    and distrust, and allowed otherwise, as are pages whose host neither reaches.

    Pages are reduced to one row per host before anything is propagated; the last join on the host is split by adaptive
    execution where one host has very many pages. Null url, or one without ``://``: empty host and path, allowed. Null
    page: no links. Null id: judged like others. Very long pages: all their links. Ties of rules in length: the greater
    string. Repeated rows: each gives its row, and counts. Empty table: no rows. Other columns are not read.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    seen = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    ruled = seen.select("id", "host", "path", matching(F.col("host"), F.col("path"), rules).alias("m"))
    per_host = ruled.where("m is not null").groupBy("host").agg(F.avg(F.col("m.allows").cast("double")).alias("p"))
    seeds = per_host.select("host", F.explode(F.array(F.struct(F.lit("t").alias("kind"), F.col("p").alias("s")), F.struct(F.lit("d").alias("kind"), (1 - F.col("p")).alias("s")))).alias("x"))
    seeds = written(seeds.select("host", "x.kind", "x.s").where("s > 0"))
    ranks = spread(written(host_edges(seen, "host", "html")), seeds, tolerance, rounds)
    bad = F.col("distrust") > most_distrust * (F.col("trust") + F.col("distrust"))
    hosts = ranks.select("host", "trust", "distrust", bad.alias("bad"))
    verdict = F.when(F.coalesce(F.col("m.allows"), ~F.coalesce("bad", F.lit(False))), "allow").otherwise("block")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return ruled.join(hosts, "host", "left").select(F.col("id").alias(id_col), "host", "path", F.col("m.rule").alias("rule"), verdict.alias("verdict"), zero("trust"), zero("distrust"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).withColumns({c: F.round(c, 6) for c in ("trust", "distrust")})


def _sql(rounds: int = 100) -> str:
    """The same with every round of the propagation as a table of its own."""
    quote = "''"
    rules = ", ".join(f"('{h}', '{p}', {str(a).lower()})" for h, p, a in RULES)
    steps = "".join(
        f""",
p{i} as materialized (select m.kind, m.b as host, sum(m.w * r.r * 0.85) as r from moves m join r{i - 1} r on r.kind = m.kind and r.host = m.a group by 1, 2),
r{i} as materialized (select kind, host, sum(r) as r from (select * from p{i} union all
  select s.kind, s.host, s.s * (1 - coalesce((select sum(r) from p{i} x where x.kind = s.kind), 0)) from start s) group by 1, 2)"""
        for i in range(1, rounds + 1)
    )
    return f"""
with raw as (select page_id, html, case when strpos(url, '://') > 0 then url[strpos(url, '://') + 3 :] else '' end as rest from pages),
p as materialized (select page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from raw),
rules(h, q, allows) as (values {rules}),
fit as (select page_id, host, path, h || q as rule, allows, row_number() over (partition by page_id, host, path order by length(h || q) desc, h || q desc) as n from (select distinct page_id, host, path from p)
  join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, q)),
ruled as materialized (select p.page_id, p.host, p.path, f.rule, f.allows from p left join (select * from fit where n = 1) f using (page_id, host, path)),
share as (select host, avg(allows::int) as a from ruled where rule is not null group by 1),
seeds as (select 't' as kind, host, a as s from share where a > 0 union all select 'd', host, 1 - a from share where a < 1),
start as materialized (select kind, host, s / sum(s) over (partition by kind) as s from seeds),
links as (select host as src, translate(regexp_extract(link, '^[^/]*//([^/?#]*)', 1), '{UPPER}', '{LOWER}') as dst from (
  select host, unnest(regexp_extract_all(html, '(?i)\\shref\\s*=\\s*["{quote}]?((?:[a-z][a-z0-9+.-]*:)?//[^"{quote}\\s>]+)', 1)) as link from p where host <> '')),
edges as materialized (select src, dst, count(*) as n from links where dst <> '' and dst <> src group by 1, 2),
moves as materialized (select 't' as kind, src as a, dst as b, n / sum(n) over (partition by src) as w from edges union all select 'd', dst, src, n / sum(n) over (partition by dst) from edges),
r0 as (select kind, host, s as r from start){steps},
hosts as (select host, coalesce(sum(r) filter (kind = 't'), 0) as trust, coalesce(sum(r) filter (kind = 'd'), 0) as distrust from r{rounds} group by 1)
select page_id, host, path, rule, case when coalesce(allows, not coalesce(distrust > 0.5 * (trust + distrust), false)) then 'allow' else 'block' end as verdict,
  round(coalesce(trust, 0), 6) as trust, round(coalesce(distrust, 0), 6) as distrust from ruled left join hosts using (host)
"""


OP2_SQL = _sql()
