"""URL filters: rules on hosts and paths, then trust propagated over host links.

Rules fit a host with all its subdomains and urls whose path starts with the
rule's; the longest fitting rule gives the verdict. All other pages are judged
by their host: links of the pages' html make edges between hosts, personalised
PageRank spreads trust from the hosts of allowed pages along the links, and
distrust from the hosts of blocked pages against them (who links to a blocked
host is suspect). A host is blocked if its distrust exceeds ``THRESHOLD`` times
the sum of both; a host that neither reaches is allowed.

Null urls and urls without ``://`` have an empty host and path, fit no rule and
are judged as the host ''. Null html has no links. Repeated pages count as often
as they occur. Empty tables give no rows. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import stored

#: Rounds of propagation between two tests of convergence, share that follows the
#: links, share of distrust that blocks.
ROUNDS, DAMPING, THRESHOLD = 12, 0.85, 0.3
#: Propagation ends when a round changes all ranks together, which sum to 1, by less.
TOLERANCE = 1e-9

_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An absolute or protocol-relative link target's host.
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _LOW)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and its verdict: ``rules`` are (verdict, 'host/path'), a fixed short list."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, r in reversed(ordered):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def settled(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """The ranks of :func:`spread` at convergence: blocks of its rounds until the
    last round changes the ranks by less than ``tolerance`` in sum. What hosts
    without links give back only scales all ranks alike, so the rounds leave it
    out (a chain then settles after as many rounds as it has links, any graph by
    ``damping`` a round) and the ranks are scaled to the sum of 1 at the end."""
    rank = None
    while True:
        before = spread(nodes, edges, ROUNDS - 1, damping, rank, back=False)
        rank = spread(nodes, edges, 1, damping, before, back=False)
        both = rank.join(before.withColumnRenamed("rank", "was"), "host")
        moved, total = both.agg(F.sum(F.abs(F.col("rank") - F.col("was"))), F.sum("rank")).first()
        if (moved or 0.0) < tolerance:
            return rank.select("host", (F.col("rank") / F.lit(total or 1.0)).alias("rank"))


def spread(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, rank: DataFrame | None = None, back: bool = True) -> DataFrame:
    """Personalised PageRank: ``host, rank`` from ``host, seed`` (seeds sum to 1
    or all are 0) over ``src, dst, weight`` (weights of a source sum to 1), after
    ``rounds`` rounds from ``rank`` or else the seeds. A host without links gives
    its rank back to the seeds (not without ``back``)."""
    base = stored(nodes, "seeds")
    dangling = None if not back else stored(base.join(edges.select(F.col("src").alias("host")).distinct(), "host", "left_anti").select("host"), "dangling")
    rank = base.select("host", F.col("seed").alias("rank")) if rank is None else rank
    for i in range(rounds):
        flow = edges.join(rank, F.col("src") == F.col("host")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("weight")).alias("flow"))
        after = base.join(flow, F.col("host") == F.col("dst"), "left")
        if back:
            lost = rank.join(dangling, "host", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
            after = after.crossJoin(F.broadcast(lost))  # one row
        else:
            after = after.withColumn("lost", F.lit(0.0))
        rank = after.select("host", ((1 - damping) * F.col("seed") + damping * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") * F.col("seed"))).alias("rank"))
        rank = stored(rank, "ranks") if i % 4 == 3 or i == rounds - 1 else rank
    return rank


def judge(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the host's ``trust`` and ``distrust``."""
    host, path = host_and_path(F.col("url"))
    rule, says = matched_rule(F.col("host"), F.col("path"), rules)
    seen = pages.select("page_id", host.alias("host"), path.alias("path"), F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1).alias("links"))
    seen = stored(seen.select("*", rule.alias("rule"), says.alias("says")), "pages")
    links = seen.select("host", F.explode("links").alias("to")).select(F.col("host").alias("src"), F.translate("to", _UPPER, _LOW).alias("dst"))
    counted = links.where("src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))
    counted = stored(counted, "links")
    per = seen.groupBy("host").agg(F.sum(F.when(F.col("says") == "allow", 1.0).otherwise(0.0)).alias("allowed"), F.sum(F.when(F.col("says") == "block", 1.0).otherwise(0.0)).alias("blocked"), F.sum(F.when(F.col("says").isNull(), 1.0).otherwise(0.0)).alias("open"))
    linked = counted.select(F.col("dst").alias("host")).distinct().withColumns({c: F.lit(0.0) for c in ("allowed", "blocked", "open")})
    hosts = stored(per.unionByName(linked).groupBy("host").agg(*(F.sum(c).alias(c) for c in ("allowed", "blocked", "open"))), "hosts")

    def ranks(column: str, src: str, dst: str) -> DataFrame:
        # one row with the total seed weight
        total = hosts.agg(F.greatest(F.sum(column), F.lit(1.0)).alias("total"))
        seeds = hosts.crossJoin(F.broadcast(total)).select("host", (F.col(column) / F.col("total")).alias("seed"))
        out = counted.groupBy(src).agg(F.sum("n").alias("out"))
        edges = counted.join(out, src).select(F.col(src).alias("src"), F.col(dst).alias("dst"), (F.col("n") / F.col("out")).alias("weight"))
        rank = settled(stored(seeds, "seeds"), stored(edges, "edges"))
        return rank.crossJoin(F.broadcast(total)).select("host", (F.col("rank") * F.col("total")).alias("rank"))

    trust = ranks("allowed", "src", "dst").withColumnRenamed("rank", "trust")
    distrust = ranks("blocked", "dst", "src").withColumnRenamed("rank", "distrust")
    judged = stored(trust.join(distrust, "host").join(hosts.select("host", "open"), "host"), "judged").withColumnRenamed("host", "_host")
    bad = F.col("distrust") > threshold * (F.col("trust") + F.col("distrust") + F.col("open"))
    out = seen.join(judged, F.col("host") == F.col("_host"), "left")
    verdict = F.coalesce("says", F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
