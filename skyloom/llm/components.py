"""Connected components of a links table by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins on (u, v) pairs; neither a neighbour list nor a component is ever held in
one task, and each round's links are written to the shared folder, so that a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.session import cut


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links of long nodes -> (node, label): the smallest node that each node of any link reaches; the smallest itself has no row."""
    links = cut(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        seen = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen["n"] == 0 or tuple(seen) == mark:
            return links.select(F.col("u").alias("node"), F.col("v").alias("label"))
        mark = tuple(seen)
        links = cut(_small_star(_large_star(links)), "links")
