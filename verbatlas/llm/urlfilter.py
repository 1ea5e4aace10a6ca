"""URL rules, and trust and distrust propagated over the graph of hosts; DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Scores of up to this many hosts are broadcast to the pages; more are joined by a shuffle.
BROADCAST_HOSTS = 200_000
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null or where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def node(host: Column) -> Column:
    """A host without user and port, as the graph knows it."""
    return F.regexp_replace(F.translate(host, UPPER, LOWER), r"^.*@|:\d*$", "")


def host_edges(pages: DataFrame, domains: bool = True) -> DataFrame:
    """``(src, dst, w)``: links between different hosts (``_node``, and hrefs in ``html``), counted.

    Relative links stay on their host and are left out. With ``domains`` a host and the domain above
    it are linked both ways, with weight one, as they are in one hand; where pages link to their own
    host only, these are all edges there are.
    """
    links = pages.select(F.col("_node").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", node(F.col("dst")).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    if not domains:
        return links
    hosts = pages.select(F.col("_node").alias("src")).where("src <> ''").distinct()
    above = hosts.select("src", F.regexp_replace("src", r"^[^.]*\.", "").alias("dst")).where("instr(dst, '.') > 0 and src <> dst")
    up = above.union(above.select("dst", "src")).select("src", "dst", F.lit(1.0).alias("w"))
    return links.union(up).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def rounds_for(tolerance: float, damping: float) -> int:
    """A round makes what two score tables differ in less by ``damping``, and they differ in 2 at most; so many leave ``tolerance``."""
    return math.ceil(math.log(tolerance / 2) / math.log(damping))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = 0.7, tolerance: float = 0.01, cut_every: int = 6) -> DataFrame:
    """``(host, trust, distrust)``: personalised PageRank from ``seeds(host, good, bad)``.

    Trust follows the edges from the trusted seeds, distrust runs against them from the blocked
    ones. Both share one table of (kind, host), so a round is one join and one aggregation. All
    scores of a kind together are within ``tolerance`` of the limit's, of a sum of one.
    """
    way = edges.select(F.lit("t").alias("kind"), "src", "dst", "w").union(edges.select(F.lit("d"), F.col("dst"), F.col("src"), "w"))
    out = way.groupBy("kind", "src").agg(F.sum("w").alias("all"))
    way = cut(way.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("all") * damping).alias("part")))
    total = seeds.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).select(F.coalesce("g", F.lit(0.0)).alias("g"), F.coalesce("b", F.lit(0.0)).alias("b"))
    own = seeds.join(F.broadcast(total)).select(F.explode(F.array(
        F.struct(F.lit("t").alias("kind"), "host", F.try_divide("good", "g").alias("seed")),
        F.struct(F.lit("d").alias("kind"), "host", F.try_divide("bad", "b").alias("seed")))).alias("x")).select("x.*").where("seed > 0")
    own = cut(own)
    rank = own.select("kind", "host", F.col("seed").alias("r"))
    start = own.select("kind", "host", (F.col("seed") * (1 - damping)).alias("r"))
    for k in range(1, rounds_for(tolerance, damping) + 1):
        moved = way.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("r") * F.col("part")).alias("r"))
        rank = moved.union(start).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        rank = cut(rank) if k % cut_every == 0 else rank
    return rank.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("r"))), F.lit(0.0)).alias(n) for k, n in (("t", "trust"), ("d", "distrust"))])


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, margin: float = 1e-6, domains: bool = True) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every page.

    A rule decides where one fits. Elsewhere the host does: it is blocked if its distrust is over
    its trust by more than the share ``margin`` of it, else allowed; a host that no seed reaches has
    no scores and is allowed. Hosts on which rules allow or block pages are
    the seeds, weighted with those pages. In the graph a host has no user and port. ``domains`` also
    links a host with the domain above it. Null urls and urls with no ``://`` have an empty host,
    which has no links and no score, and so are allowed; a null html has no links. Repeated rows
    count as often as they stand there, and give a row each. An empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    x = pages.select("page_id", host.alias("_host"), path.alias("_path"), node(host).alias("_node"), "html")
    rule, verdict = first_rule(F.col("_host"), F.col("_path"), rules)
    x = x.withColumns({"_rule": rule, "_said": verdict})
    seeds = x.where("_said is not null and _node <> ''").groupBy(F.col("_node").alias("host")).agg(*[F.count_if(F.col("_said") == k).cast("double").alias(n) for k, n in (("allow", "good"), ("block", "bad"))])
    scores = cut(propagated(host_edges(x, domains), seeds))  # a plain table, so that a join beyond the bound can split a host of many pages
    scores = F.broadcast(scores) if scores.count() <= BROADCAST_HOSTS else scores
    by_host = F.when(F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0)) * (1 + margin), F.lit("block")).otherwise(F.lit("allow"))
    return x.drop("html").join(scores.withColumnRenamed("host", "_node"), "_node", "left").select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"),
        F.coalesce("_said", by_host).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
