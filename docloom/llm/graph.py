"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import settle


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, comp) for the nodes of ``edges`` (a, b): comp is the least node that links reach.

    Each round hangs a node's larger neighbours, then its smaller ones, on the least of them, as two
    aggregations and two joins; rounds go on until the links stay the same. Nothing is collected.
    """
    flat = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    for _ in range(most):
        both = flat.unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        flat = settle(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = tuple(flat.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("links did not settle")
    tops = flat.select(F.col("v").alias("node")).distinct().withColumn("comp", F.col("node"))
    return flat.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(tops)
