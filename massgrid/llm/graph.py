"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massgrid.llm.common import saved


def components(links: DataFrame, folder: str | None = None, most_rounds: int = 60) -> DataFrame:
    """(vertex, component) of every vertex with a link; component is the smallest vertex of its group.

    `links` has two long columns a and b. The links never leave the executors: each round is two
    aggregations and joins, is written to the shared folder (or the one given), and ends when the links stay the same.
    Rounds grow with the logarithm of a group's size. A hub's links are spread by Spark's skew join.
    """
    e = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", folder)
    mark = None
    for _ in range(most_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e = saved(small, "links", folder)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (now.n, now.h):
            break
        mark = (now.n, now.h)
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
