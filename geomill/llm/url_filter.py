"""URL verdicts from rules and from the link graph of hosts.

Rules name a host (which covers its subdomains) and a path prefix; the longest rule
that fits decides. All other urls are judged by their host: trust is personalised
PageRank from hosts whose pages the rules allow, along links; distrust is the same
walk from hosts whose pages they block, against the links. A host is blocked if its
distrust exceeds its trust by the factor `factor`, however small both are, so a verdict
doesn't depend on the number of seeds elsewhere. Walks go on until the ranks are settled.

Only DataFrame functions are used. Links are counted per pair of hosts before they
are shuffled, so a host with a third of all pages is one row of each iteration; the
ranks are checkpointed to the shared folder every few rounds, and compared there.

Defined results: a null url or one without :// has empty host and path and no rule,
and is allowed; null or empty html has no links; repeated rows each give a row and
count their links each; null ids are kept; urls and html of any length are read whole; a host
without outgoing links keeps its rank; without seeds of a kind that rank is 0 everywhere; an
empty table gives an empty table; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomill.llm.workspace import broadcast_if_small, checkpointed, written


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("org", "/", True), Rule("example.org", "/es/", False), Rule("example.org", "/en/1", False), Rule("com", "/fr/", True), Rule("com", "/de/", False))
DAMPING, EVERY, FACTOR = 0.85, 5, 1.0
#: Ranks are settled if no host is new and all together changed by no more than this; rounds after which less than a double can tell is still on its way.
SETTLED, ROUNDS = 1e-13, 227


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and decision of the longest rule that fits; null without one. A tie of two rules with one name goes to the one listed last."""
    name, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: len(r.name)) if rules else ():
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, allow = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.allow)).otherwise(allow)
    return name, allow


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between hosts. A link without a host stays on its own."""
    url = F.col(url_col)
    found = F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^\s"'>]*|[^\s"'>]*)"""), 1)
    # Links are counted inside each page first: by host, most pages have one row.
    target = F.transform(found, lambda h: F.when(h.rlike(r"^(?i)([a-z][a-z0-9+.-]*:)?//"), _lower(F.regexp_extract(h, r"^[^/]*//([^/?#]*)", 1))).when(h.rlike(r"^(?i)[a-z][a-z0-9+.-]*:"), F.lit("")).otherwise(F.lit(None).cast("string")))
    page = pages.select(host_of(url).alias("src"), target.alias("target")).filter("src <> ''")
    own = page.select("src", F.col("src").alias("dst"), F.size(F.filter("target", lambda t: t.isNull())).alias("k"))
    other = page.select("src", F.explode(F.filter("target", lambda t: t.isNotNull() & (t != ""))).alias("dst")).withColumn("k", F.lit(1))
    return own.unionByName(other).groupBy("src", "dst").agg(F.sum("k").alias("n")).filter("n > 0")


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, every: int = EVERY, settled: float = SETTLED) -> DataFrame:
    """(walk, host, rank): personalised PageRank of several walks at once, along edges (walk, src, dst, n) from seeds (walk, host, weight), once it is settled; the ranks of a walk with a seed sum to 1."""
    weight = seeds.groupBy("walk").agg(F.sum("weight").alias("all"))
    start = checkpointed(seeds.filter("weight > 0").join(weight, "walk").select("walk", "host", (F.col("weight") / F.col("all")).alias("start")))
    # A host without outgoing links gets one to itself, so no rank is lost on the way.
    reached = edges.select("walk", F.col("dst").alias("src")).unionByName(start.select("walk", F.col("host").alias("src"))).distinct()
    ends = reached.join(edges.select("walk", "src").distinct(), ["walk", "src"], "left_anti").select("walk", "src", F.col("src").alias("dst"), F.lit(1).alias("n"))
    edges = edges.select("walk", "src", "dst", "n").unionByName(ends)
    total = edges.groupBy("walk", "src").agg(F.sum("n").alias("total"))
    share = checkpointed(edges.join(total, ["walk", "src"]).select("walk", F.col("src").alias("host"), "dst", (F.col("n") / F.col("total")).alias("share")))
    back = start.select("walk", "host", (F.col("start") * (1 - damping)).alias("part"))
    before = rank = start.withColumnRenamed("start", "rank")
    for i in range(rounds):
        flow = rank.join(share, ["walk", "host"]).select("walk", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("part"))
        rank = flow.unionByName(back).groupBy("walk", "host").agg(F.sum("part").alias("rank"))
        if i % every == every - 1 or i == rounds - 1:
            rank = checkpointed(rank)
            old = before.select("walk", "host", F.col("rank").alias("old"))
            moved = rank.join(old, ["walk", "host"], "full").agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("by"), F.count_if(F.col("old").isNull()).alias("new")).first()
            if not moved["new"] and (moved["by"] or 0.0) <= settled:
                break
            before = rank
    return rank


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, factor: float = FACTOR, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **walk) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) for each row."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    name, allow = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumns({"rule": name, "allow": allow})
    edges = written(links(pages, url_col, html_col))
    seeds = judged.filter("allow is not null").groupBy("host").agg(F.sum(F.col("allow").cast("double")).alias("good"), F.sum((~F.col("allow")).cast("double")).alias("bad"))
    seeds = seeds.select("host", F.inline(F.array(F.struct(F.lit("trust").alias("walk"), F.col("good").alias("weight")), F.struct(F.lit("distrust").alias("walk"), F.col("bad").alias("weight")))))
    both = edges.withColumn("walk", F.lit("trust")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", F.lit("distrust").alias("walk")))
    ranks = propagate(both, checkpointed(seeds), **walk)
    of = lambda name: F.coalesce(F.sum(F.when(F.col("walk") == name, F.col("rank"))), F.lit(0.0)).alias(name)
    ranks = checkpointed(ranks.groupBy("host").agg(of("trust"), of("distrust")))
    # The hosts' ranks are broadcast if their number allows; beyond that Spark shuffles the pages by host.
    out = judged.join(broadcast_if_small(ranks, 120), "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    blocked = F.col("distrust") > factor * F.col("trust")
    verdict = F.when(F.coalesce("allow", ~blocked), "allow").otherwise("block")
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
