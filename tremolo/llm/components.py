"""Connected components of links, by alternating star operations on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.session import Stage


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """(node, component), written: the smallest node that is reachable, for each node of an edge.

    ``edges`` has a and b, in any direction. A round ties each node's larger neighbours to the
    smallest node around it, then its smaller ones; it ends when a round changes nothing, after
    as many rounds as it takes (about the logarithm of the longest path, squared at most). Nodes
    with many links are aggregated by task before they are shuffled.
    """
    e = stage.write(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v"), F.col("m").alias("u"))
        large = large.where("u < v").distinct()
        # Small star: v's smaller neighbours and v itself go to the smallest of them.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(low.select("v", F.col("m").alias("u")))
        new = stage.write(small.where("u < v").distinct())
        stage.drop(e)
        e = new
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    nodes = e.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return stage.write(nodes.unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()))
