"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component) for every id in links (a, b); component is the smallest id that links reach.

    Each round is two joins over tables in the shared folder; their number grows with the logarithm of the components'
    diameters; RuntimeError where `rounds` don't suffice. Joins are equi-joins on one end, which the engine splits where one id has very many links.
    """
    both = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, state = store.save(both, "stars", compact=True), None
    for _ in range(rounds):
        # Large star: neighbours above u are linked to u's smallest neighbour.
        sides = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sides.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u's neighbours below it and u are linked to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, store.save(small, "stars", compact=True)
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        store.drop(last)
        if got == state:
            break
        state = got
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
