"""Connected components of an edge table, by alternating large-star and small-star steps.

(Kiveris et al., "Connected components in MapReduce and beyond", 2014.)  Each step is a
grouped minimum, pre-aggregated before its shuffle, and a join back; no node's neighbours
are gathered in one place, and nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges if not large else edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:  # from the larger end to the smaller
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    met = both.join(least, both.u == least.w)
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of an edge that isn't its component's smallest node.

    ``edges`` has two long columns u and v, in any direction, repeats and loops allowed.
    """
    now = written(edges.where("u is not null and v is not null and u <> v").distinct())
    digest = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = digest(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        now = written(_star(_star(now, True), False))
        after = digest(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
