"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cuts, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges ``(u, v)``, each in the direction the step needs.

    Large-star: every node links its larger neighbours to its smallest one. Small-star:
    every node links itself and its smaller neighbours to the smallest. A node's minimum is
    pre-aggregated and joined back, so no neighbourhood is gathered in one place.
    """
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    joined = edges.join(least, "u").select("u", "v", F.least("u", "least").alias("m"))
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    ends = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    return moved.filter("u <> v").select(*ends).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; the component is its smallest node.

    Links with a null end and links of a node to itself count for nothing; with no links the
    result is empty. Each round's edges are written to the shared folder, and deleted when the
    next round's are.
    """
    spark = links.sparkSession
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state, last = None, Cuts(spark)
    try:
        while True:
            cut = Cuts(spark)
            edges = cut(_star(_star(edges, large=True), large=False))
            last.clear()
            last = cut
            sums = F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
            now = edges.agg(F.count("*"), *sums).first()
            if now == state or not now[0]:
                break
            state = now
        leaves = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return written(leaves.unionByName(centres))
    finally:
        last.clear()
