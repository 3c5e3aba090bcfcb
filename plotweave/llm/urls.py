"""URL filters: rules, and link-graph propagation for the hosts no rule fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import cut, discard

# Fixed values: (verdict, host, path) of the rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING = 0.85
#: The propagation ends when ``STRIDE`` rounds add less than this to the sum of the scores (at most 2) and reach no new host.
SETTLED, STRIDE = 1e-6, 8
#: A host is blocked if its distrust is more than this share of trust and distrust.
BLOCK_SHARE = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does. Equal lengths: the first listed."""
    rule = verdict = None
    for kind, rule_host, rule_path in sorted(rules, key=lambda x: -len(x[1] + x[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path) if rule is None else rule.when(fits, rule_host + rule_path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _rank(edges: DataFrame, seeds: DataFrame, damping: float, rounds: int | None, settled: float) -> DataFrame:
    """(way, host, score): personalised PageRank along ``edges`` (way, src, dst, share) from ``seeds`` (way, host, seed).

    Shares leaving a host sum to one; what reaches a host without edges ends there. Sums
    are aggregated before each shuffle. ``STRIDE`` rounds are one plan, in which the edges
    are shuffled once, and leave a table of one row per way and host reached in the shared
    folder. Scores only grow, so the difference of two sums is the whole change between
    them: one sum and one count per table reach the driver.
    """
    base = cut(seeds.select("way", "host", (F.col("seed") * (1 - damping)).alias("score")))
    by_source = edges.repartition("way", "src")
    score, turn, before = base, 0, (0.0, 0)
    while rounds is None or turn < rounds:
        steps = STRIDE if rounds is None else min(STRIDE, rounds - turn)
        after = score
        for _ in range(steps):
            met = by_source.join(after.withColumnRenamed("host", "src"), ["way", "src"])
            flow = met.select("way", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
            after = flow.unionByName(base).groupBy("way", "host").agg(F.sum("score").alias("score"))
        after = cut(after)
        if score is not base:
            discard(score)
        score, turn = after, turn + steps
        now = score.agg(F.coalesce(F.sum("score"), F.lit(0.0)), F.count(F.lit(1))).first()
        if rounds is None and now[1] == before[1] and now[0] - before[0] < settled:
            break
        before = now
    return score


def propagate(
    edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None, settled: float = SETTLED
) -> DataFrame:
    """(host, trust, distrust) from weighted host edges (src, dst, n) and seeds (host, allowed, blocked).

    Trust starts at hosts with allowed pages, in proportion to them, and follows links.
    Distrust starts at hosts with blocked pages and follows links backwards: who links to
    blocked hosts is distrusted. Both run together until they settle, so every host that a
    path joins to a seed gets its share; ``rounds`` asks for a fixed number instead.
    """

    def shares(way: str, a: str, b: str) -> DataFrame:
        out = edges.groupBy(a).agg(F.sum("n").alias("all"))
        share = (F.col("n") / F.col("all")).alias("share")
        return edges.join(out, a).select(F.lit(way).alias("way"), F.col(a).alias("src"), F.col(b).alias("dst"), share)

    def start(way: str, column: str) -> DataFrame:
        total = seeds.agg(F.sum(column)).first()[0] or 0
        seed = (F.col(column) / F.lit(float(total or 1))).alias("seed")
        return seeds.where(F.col(column) > 0).select(F.lit(way).alias("way"), "host", seed)

    both = cut(shares("trust", "src", "dst").unionByName(shares("distrust", "dst", "src")))
    ranks = _rank(both, start("trust", "allowed").unionByName(start("distrust", "blocked")), damping, rounds, settled)
    of = lambda way: F.coalesce(F.sum(F.when(F.col("way") == way, F.col("score"))), F.lit(0.0)).alias(way)
    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts in the whole html of ``pages`` (host, html)."""
    found = pages.select(
        F.col("host").alias("src"),
        F.explode(F.regexp_extract_all(F.col("html"), F.lit(r"(?i)(?:href|src|action)\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^\"'\s<>/?#]+)"), 1)).alias("dst"),
    )
    dst = F.translate("dst", _UPPER, _LOWER)
    return (
        found.withColumn("dst", dst).where((F.col("src") != "") & (F.col("dst") != F.col("src")))
        .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    )


def sibling_edges(hosts: DataFrame) -> DataFrame:
    """(src, dst, n): each host and its parent domain, both ways; parents take part as hosts of their own.

    Pages of one site link to each other through their domain, so a host's standing
    reaches its sub-domains. One edge pair per label, never one per pair of siblings.
    """
    up = hosts.where(F.size(F.split("host", r"\.")) > 2).select(
        F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]*\.(.*)$", 1).alias("dst")
    )
    both = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.distinct().withColumn("n", F.lit(1).cast("long"))


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, block_share: float = BLOCK_SHARE) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) per row of ``pages``.

    A page takes the verdict of the longest rule that fits its url. The others take their
    host's: blocked if distrust is over ``block_share`` of trust and distrust there,
    allowed otherwise, also for hosts that no path joins to a seed. Seeds are the pages that
    rules allow or block. Null urls and urls without ``://`` have an empty host and
    path and are allowed. Null html has no links. Repeated rows weigh as rows, extra
    columns are not read, an empty table gives no rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = cut(named.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled")))
    seeds = cut(
        judged.groupBy("host").agg(
            F.count(F.when(F.col("ruled") == "allow", 1)).alias("allowed"),
            F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"),
        )
    )
    links = host_edges(pages.select(host.alias("host"), "html"))
    edges = cut(links.unionByName(sibling_edges(seeds.where("host <> ''").select("host"))).groupBy("src", "dst").agg(F.sum("n").alias("n")))
    ranks = propagate(edges, seeds.where("host <> ''"))
    bad = F.col("distrust") > F.lit(block_share) * (F.col("trust") + F.col("distrust"))
    known = cut(ranks.select("host", "trust", "distrust", F.when(bad, "block").otherwise("allow").alias("standing")))
    return judged.join(known, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "standing", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
