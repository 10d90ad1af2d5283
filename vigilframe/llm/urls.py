"""URL filters: rules, and link-graph propagation of trust for urls without one (operator 5).

Trust is personalised PageRank over host links from hosts whose pages the rules allow; distrust is the same over reversed
links from hosts whose pages the rules block, each with its share of the links to the host it is left from. A host whose
distrust exceeds its trust by a factor is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

#: (rule, verdict); a rule is a host and the beginning of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Changes shrink by DAMPING a round, so about 90 rounds and those it takes to reach the farthest host; ROUNDS is an error.
DAMPING, ROUNDS, TOLERANCE, FACTOR = 0.85, 1000, 1e-6, 2.0
_url = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_upper, _lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_link = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^"'\s>/?#]+)"""


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _url, 1), _upper, _lower), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _url, 2), F.lit(""))


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (host, path), as struct<rule, verdict>; null where none does."""
    out = None
    for text, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        value = F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def counts(pages: DataFrame) -> DataFrame:
    """(src, dst, n): how many links lead from host to host; none to the same host. Null html has none."""
    found = F.transform(F.regexp_extract_all("html", F.lit(_link), 1), lambda x: F.translate(x, _upper, _lower))
    one = pages.select(host(F.col("url")).alias("src"), F.explode(found).alias("dst")).filter("src != '' and dst != '' and src != dst")
    return one.groupBy("src", "dst").agg(F.count("*").alias("n"))


def shares(counts: DataFrame, backwards: bool = False) -> DataFrame:
    """(src, dst, weight) of a walk along counts (or backwards): weights are shares of all links that leave src on the walk,
    and so sum to 1 there in either direction."""
    n = counts.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n") if backwards else counts
    return n.join(n.groupBy("src").agg(F.sum("n").alias("all")), "src").select("src", "dst", (F.col("n") / F.col("all")).alias("weight"))


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts, with their share of src's."""
    return shares(counts(pages))


def rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank (host, score) of edges (src, dst, weight) for seeds (host, score) that sum to 1.

    Mass of hosts without outgoing edges returns to the seeds. Without edges the seeds keep their scores. Rounds go on until
    no host's score changes by more than the tolerance of itself (so hosts far from a seed count as well, as verdicts
    compare scores of one host); RuntimeError where they run out before.
    """
    begin = seeds.select("host", "score")
    if edges.isEmpty():
        return store.save(begin, "rank", compact=True)
    leaves = edges.select(F.col("src").alias("host")).distinct().withColumn("leaves", F.lit(True))
    edges = store.save(edges.join(leaves.withColumnRenamed("host", "dst"), "dst", "left").select("src", "dst", "weight", F.coalesce("leaves", F.lit(False)).alias("leaves")), "edges", compact=True)
    first = begin.join(leaves, "host", "left").select("host", "score", F.coalesce("leaves", F.lit(False)).alias("leaves"), F.lit(0.0).alias("last"))
    first = now = store.save(first, "rank", compact=True)
    zero, moving = F.lit(0.0), F.sum(F.when(F.col("leaves"), F.col("score")))
    moved = now.agg(moving).first()[0] or 0.0
    for _ in range(rounds):
        flow = now.join(edges.withColumnRenamed("leaves", "on"), now.host == edges.src).select(F.col("dst").alias("host"), (damping * F.col("score") * F.col("weight")).alias("score"), F.col("on").alias("leaves"), zero.alias("last"))
        back = first.select("host", ((1 - damping * moved) * F.col("score")).alias("score"), "leaves", zero.alias("last"))
        parts = flow.unionByName(back).unionByName(now.select("host", zero.alias("score"), "leaves", F.col("score").alias("last")))
        last, now = now, store.save(parts.groupBy("host").agg(F.sum("score").alias("score"), F.max("leaves").alias("leaves"), F.sum("last").alias("last")), "rank", compact=True)
        moved, unsettled = now.agg(moving, F.count_if(F.abs(F.col("score") - F.col("last")) > tolerance * F.col("score") + 1e-300)).first()
        moved = moved or 0.0
        if last is not first:
            store.drop(last)
        if not unsettled:
            break
    else:
        raise RuntimeError(f"scores of {unsettled} hosts not settled after {rounds} rounds")
    store.drop(edges)
    store.drop(first)
    return now.select("host", "score")


def judge(pages: DataFrame, rules=RULES, factor: float = FACTOR) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    A url that is null or has no `://` has an empty host and path, which no rule fits and which the graph doesn't hold: it
    is allowed. Without links, hosts keep what their own pages' rules say; a host of which nothing is known is allowed.
    Repeated pages are judged and counted each; other columns are ignored; an empty table gives no rows.
    """
    h, p = host(F.col("url")), path(F.col("url"))
    ruled = pages.select("page_id", h.alias("host"), p.alias("path")).withColumn("r", rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("said"))
    by_host = store.save(ruled.filter("said is not null").groupBy("host").agg(F.count_if(F.col("said") == "allow").alias("allow"), F.count_if(F.col("said") == "block").alias("block")), "seeds", compact=True)
    linked = store.save(counts(pages), "links", compact=True)
    total = by_host.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()

    def seeds(kind: str) -> DataFrame:
        return by_host.filter(F.col(kind) > 0).select("host", (F.col(kind) / F.lit(float(total[kind] or 1))).alias("score"))

    trust = rank(shares(linked), seeds("allow"))
    distrust = rank(shares(linked, backwards=True), seeds("block"))
    bad = distrust.withColumnRenamed("score", "bad").join(trust, "host", "left").filter(F.col("bad") > factor * F.coalesce("score", F.lit(0.0))).select("host", F.lit("block").alias("graph"))
    return ruled.join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("said", "graph", F.lit("allow")).alias("verdict"))
