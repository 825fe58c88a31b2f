"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.workspace import Workspace


def components(work: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of `edges` (columns a and b); a component is named after its smallest node.

    Alternating large and small stars: each round joins every node's neighbours to the least of them, so
    a chain shrinks by a constant factor and a star is done at once. A round is written to the shared
    folder. Minima are combined before the shuffle, and joins on a hub can be split by Spark.
    """
    now = work.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct()
        after = work.table(small)
        work.drop(now)
        now = after
        seen = now.select(F.xxhash64("u", "v").cast("decimal(20,0)").alias("h")).agg(F.count("*"), F.sum("h")).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
