"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobfacts.llm.common import apart, written


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node of `edges` (a, b) that is not itself the smallest.

    Each round hangs neighbours onto the smallest node around them (a node's minimum is formed before any join, and a
    node of many links is only a skewed key of that join) and is written to the shared folder; links never multiply.
    """
    now = written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    before, state = None, _digest(now)
    while state != before:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(apart(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(apart(least, "u"), "u").select("u", "v", "m")
        onto = small.select(F.col("u"), F.col("m").alias("v")).union(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = written(onto.distinct(), "links")
        before, state = state, _digest(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
