"""Verdicts on URLs by rules, and for the rest by trust and distrust that spread over links between hosts.

Hosts with a page that a rule allows are trusted seeds, hosts with a page that a rule blocks are blocked
seeds. Personalised PageRank carries trust along the links, from the linking to the linked host; distrust runs
the other way, from a blocked host to those that link to it. A host with more distrust than `THRESHOLD`
times its trust is blocked, every other is allowed. A host without outgoing links passes nothing on.

Page texts are read once, for the host edges; edges are counted per pair of hosts before they are joined, and a
round moves one row per host and edge. `judge` goes on until the hosts that have a rank stay the same and a round changes all ranks
by `TOLERANCE` in total or less, so a host at any distance has its share; `ROUNDS` holds for `spread` without a tolerance and for the SQL. Lineage
is cut by stored tables.

Defined results: a null URL, or one without `://`, has an empty host and path, fits no rule, and is allowed;
a null page has no links; repeated rows and null ids each give a row; an empty table gives an empty result; other columns
of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.session import materialize

DAMPING, ROUNDS, THRESHOLD = 0.85, 8, 1.0
#: Total change of all ranks in a round at which they count as settled, as a share of what the seeds start with.
TOLERANCE = 1e-9
#: Rounds between two stored tables.
STORED_EVERY = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']([^"']*)["']"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host):]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def longest_rule(rules: list[Rule], host: Column, path: Column, value) -> Column:
    """`value(rule)` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """source and target of links between different hosts, with the number of links. `pages`: host, html."""
    links = pages.select(F.col("host").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("link"))
    absolute = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    edges = links.select("source", host_of(absolute).alias("target")).where("target <> '' and source <> '' and source <> target")
    return edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("links"))


def spread(edges: DataFrame, seeds: DataFrame, tolerance: float | None = None) -> DataFrame:
    """host, trust and distrust after `ROUNDS` rounds, or settled to a tolerance. `seeds`: host, trusted and blocked (0 or 1)."""
    both = edges.select(F.lit("trust").alias("kind"), F.col("source").alias("giver"), F.col("target").alias("taker"), "links").union(
        edges.select(F.lit("distrust"), "target", "source", "links")
    )
    given = both.groupBy("kind", "giver").agg(F.sum("links").alias("all_links"))
    shares = both.join(given, ["kind", "giver"]).select("kind", "giver", "taker", (F.col("links") / F.col("all_links")).alias("share"))
    shares = materialize(shares, "host-shares")
    start = seeds.where("trusted = 1").select(F.lit("trust").alias("kind"), "host").union(
        seeds.where("blocked = 1").select(F.lit("distrust"), "host")
    ).withColumn("rank", F.lit(1 - DAMPING))
    start = materialize(start, "seeds")
    ranks, number, settled, hosts = start, 0, not shares.take(1), -1
    while not settled:
        before = ranks
        givers = ranks.withColumnRenamed("host", "giver")
        passed = givers.join(shares, ["kind", "giver"]).select(
            "kind", F.col("taker").alias("host"), (F.col("rank") * F.col("share") * DAMPING).alias("rank"))
        ranks = start.union(passed).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        number += 1
        if number % STORED_EVERY == 0:
            ranks = materialize(ranks, "host-ranks")
        if tolerance is None:
            settled = number == ROUNDS
        elif number % STORED_EVERY == 0:
            change, n, mass = _change(before, ranks, start)
            settled, hosts = n == hosts and change <= tolerance * mass, n
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    return ranks.groupBy("host").agg(total("trust"), total("distrust"))


def _change(before: DataFrame, after: DataFrame, start: DataFrame) -> tuple[float, int, float]:
    """Total change of the ranks in a round, how many ranks there are, and what the seeds start with."""
    both = before.select("kind", "host", (-F.col("rank")).alias("rank"), F.lit(0).alias("now")).union(
        after.select("kind", "host", "rank", F.lit(1)))
    moved = both.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("now").alias("now"))
    change, n = moved.agg(F.sum(F.abs("rank")), F.sum("now")).first()
    return change or 0.0, n or 0, start.agg(F.sum("rank")).first()[0] or 0.0


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits), verdict."""
    placed = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    ruled = placed.select(
        "id", "host", "path", longest_rule(rules, F.col("host"), F.col("path"), lambda r: r.text).alias("rule"),
        longest_rule(rules, F.col("host"), F.col("path"), lambda r: r.verdict).alias("by_rule"),
    )
    seeds = ruled.where("rule is not null").groupBy("host").agg(
        F.max((F.col("by_rule") == "allow").cast("int")).alias("trusted"), F.max((F.col("by_rule") == "block").cast("int")).alias("blocked"))
    edges = materialize(host_edges(pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))), "host-edges")
    blocked = spread(edges, seeds, TOLERANCE).where(F.col("distrust") > F.col("trust") * threshold).select(F.col("host").alias("bad"))
    return ruled.join(blocked, F.col("host") == F.col("bad"), "left").select(
        "id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("bad").isNotNull(), "block").otherwise("allow")).alias("verdict"),
    )


def oracle_sql(rules: list[Rule]) -> str:
    """The same result in DuckDB SQL over `pages`, with `ROUNDS` rounds written out; links that reach further than that are not in it."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    host = lambda url: f"coalesce(translate(regexp_extract({url}, {quoted(PARTS)}, 1), '{UPPER}', '{LOWER}'), '')"
    cases = lambda value: "case " + " ".join(
        f"when (host = {quoted(r.host)} or host like {quoted('%.' + r.host)}) and starts_with(path, {quoted(r.path)}) then {quoted(value(r))}"
        for r in sorted(rules, key=lambda r: -len(r.text))) + " end"
    rounds = "".join(f""",
    r{i} as (select kind, host, sum(rank) as rank from (
        select * from r0 union all
        select s.kind, s.taker, r.rank * s.share * {DAMPING} from r{i - 1} r join shares s on s.kind = r.kind and s.giver = r.host)
        group by 1, 2)""" for i in range(1, ROUNDS + 1))
    return f"""
    with placed as (select page_id, html, {host('url')} as host, coalesce(regexp_extract(url, {quoted(PARTS)}, 2), '') as path from pages),
    ruled as (select page_id, host, path, {cases(lambda r: r.text)} as rule, {cases(lambda r: r.verdict)} as by_rule from placed),
    links as (select host as source, unnest(list_distinct(regexp_extract_all(html, {quoted(LINK)}, 1))) as link from placed),
    hosts as (select source, {host("case when starts_with(link, '//') then 'http:' || link else link end")} as target from links),
    edges as (select source, target, count(*) as n from hosts where target <> '' and source <> '' and source <> target group by 1, 2),
    both_ as (select 'trust' as kind, source as giver, target as taker, n from edges union all select 'distrust', target, source, n from edges),
    shares as (select kind, giver, taker, n / sum(n) over (partition by kind, giver) as share from both_),
    r0 as (select distinct case by_rule when 'allow' then 'trust' else 'distrust' end as kind, host, 1 - {DAMPING} as rank from ruled where rule is not null){rounds},
    bad as (select host from r{ROUNDS} group by 1 having coalesce(sum(rank) filter (kind = 'distrust'), 0) > coalesce(sum(rank) filter (kind = 'trust'), 0) * {THRESHOLD})
    select page_id, host, path, rule, coalesce(by_rule, case when host in (select host from bad) then 'block' else 'allow' end) as verdict from ruled"""
