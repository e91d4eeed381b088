"""Connected components of a graph given by links, as repeated joins over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import stage


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of `links` (a, b); root is the smallest node of the component.

    Large-star and small-star turns: every node's neighbours are tied to the smallest one, until
    nothing changes, which takes a number of turns that grows with the logarithm of the longest chain
    of links. Minima are combined before the shuffle and tables of a turn are joined by node, so a
    hub's links are spread by Spark's skew join. Each turn is written to the shared folder. NULL ends
    are left out; an empty table gives no nodes.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    links = stage(links, "links")
    before = _fingerprint(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(smallest, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(smallest.select("a", F.col("m").alias("b"))).distinct())
        links = stage(small, "links")
        after = _fingerprint(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
