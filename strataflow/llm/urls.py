"""Urls judged by host rules, and by trust and distrust that spread over the links between hosts.

A page's own rule decides first. For the others, personalised PageRank runs over host edges from hosts that the rules
mostly allow (along links) and from hosts that they mostly block (against links: who links to a blocked host).
Edges are summed per pair of hosts before the first shuffle of the iteration.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.session import materialise

from .common import ascii_lower


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]
DAMPING = 0.85
#: Rounds go on until what the ranks can still change, summed over all hosts, is below this share of the floor of one host.
TOLERANCE = 0.01
#: Rounds between two looks at the change; the ranks are written then.
ROUNDS_WRITTEN = 3
#: A host is a seed if over this share of its urls have one verdict by rules.
SEED_SHARE = 0.5
#: A host is blocked if its distrust is over this share of its trust and distrust, and it has at least FLOOR times the mean host's rank.
DISTRUST_SHARE, FLOOR = 0.6, 0.05


def host_of(url: Column) -> Column:
    after = F.substring_index(url, "://", 1)
    rest = F.substring(url, F.length(after) + 4, F.length(url))
    return F.coalesce(F.when(F.contains(url, F.lit("://")), ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))), F.lit(""))


def path_of(url: Column) -> Column:
    after = F.substring_index(url, "://", 1)
    rest = F.substring(url, F.length(after) + 4, F.length(url))
    return F.coalesce(F.when(F.contains(url, F.lit("://")), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _links(pages: DataFrame) -> DataFrame:
    """(src, link): the different absolute links of every page; those without a scheme have the page's."""
    found = F.expr(r"""regexp_extract_all(html, '(?i)\\shref\\s*=\\s*["'']?\\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\\s<>]+)', 1)""")
    scheme = F.coalesce(F.when(F.contains("url", F.lit("://")), F.substring_index("url", "://", 1)), F.lit("http"))
    whole = F.transform(found, lambda x: F.when(x.startswith("//"), F.concat(scheme, F.lit(":"), x)).otherwise(x))
    return pages.where(F.col("html").isNotNull()).select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(whole)).alias("link"))


def host_ranks(pages: DataFrame, rules: list[Rule] = RULES, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) for hosts of pages and of links that the ranks reach; both sum to 1 or less.

    A host's rank leaves only over its links, so what dangling hosts hold is lost. A round shrinks every change by
    the damping at least, so the number of rounds grows with the logarithm of the number of hosts, and no verdict waits on
    ranks that have not arrived.
    """
    links = _links(pages.select("url", "html"))
    judged = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).unionByName(links.select(host_of(F.col("link")).alias("host"), path_of(F.col("link")).alias("path")))
    verdict = rule_of(F.col("host"), F.col("path"), rules)[1]
    shares = judged.where(F.col("host") != "").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(verdict == "allow").alias("good"), F.count_if(verdict == "block").alias("bad"))
    hosts = materialise(shares.select("host", (F.col("good") > F.col("n") * SEED_SHARE).alias("trusted"), (F.col("bad") > F.col("n") * SEED_SHARE).alias("blocked")))
    pairs = materialise(links.select("src", host_of(F.col("link")).alias("dst")).where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")))
    both = pairs.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "w").unionByName(pairs.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "w"))
    sums = both.groupBy("kind", "a").agg(F.sum("w").alias("total"))
    edges = materialise(both.join(sums, ["kind", "a"]).select("kind", "a", "b", (F.col("w") / F.col("total")).alias("share")))
    seeds = hosts.where("trusted").select(F.lit("trust").alias("kind"), "host").unionByName(hosts.where("blocked").select(F.lit("distrust").alias("kind"), "host"))
    sizes = {r["kind"]: r["n"] for r in seeds.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    start = seeds.select("kind", "host", F.when(F.col("kind") == "trust", 1.0 / sizes.get("trust", 1)).otherwise(1.0 / sizes.get("distrust", 1)).alias("s"))
    start = materialise(start)
    ranks = start.withColumnRenamed("s", "r")
    # without links between hosts a round changes nothing
    left, most = float(edges.limit(1).count()), tolerance * FLOOR / max(1, hosts.count())
    while left > most:
        before = ranks
        for _ in range(ROUNDS_WRITTEN):
            sent = ranks.withColumnRenamed("host", "a").join(edges, ["kind", "a"]).select("kind", F.col("b").alias("host"), (F.col("r") * F.col("share") * damping).alias("r"))
            ranks = sent.unionByName(start.select("kind", "host", (F.col("s") * (1 - damping)).alias("r"))).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        ranks = materialise(ranks)
        change = ranks.unionByName(before.select("kind", "host", (-F.col("r")).alias("r"))).groupBy("kind", "host").agg(F.abs(F.sum("r")).alias("r")).agg(F.sum("r").alias("r")).first()["r"]
        kept = damping**ROUNDS_WRITTEN
        left = (change or 0.0) * kept / (1 - kept)
    return ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("r")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("r")).otherwise(0.0)).alias("distrust"))


def judged_pages(pages: DataFrame, rules: list[Rule] = RULES, distrust_share: float = DISTRUST_SHARE) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, trust, distrust.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed, as is every host that no
    distrust reaches. Repeated rows keep their number. Null html has no links. Rank sums are over all pages.
    """
    ranks = materialise(host_ranks(pages, rules))
    floor = FLOOR / max(1, ranks.count())
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = named.join(ranks, "host", "left").withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    spread = F.when((F.col("distrust") >= floor) & (F.col("distrust") > distrust_share * (F.col("trust") + F.col("distrust"))), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, spread).alias("verdict"), "trust", "distrust")


