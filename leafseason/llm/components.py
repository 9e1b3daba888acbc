"""Connected components by alternating large-star and small-star steps over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafseason.llm.common import delete, write_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie neighbours to the smallest of them. Minima are aggregated before the join, so a node with many neighbours
    is never gathered, and its rows may be split over tasks."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; edges has long columns u and v, root is the smallest node reachable.

    Each round is written to the shared folder, and the round before it is deleted. The loop ends when a round changes nothing; rounds grow with the
    logarithm of the longest chain. Self-edges are ignored; an empty table gives an empty result.
    """
    now, path = write_table(edges.select("u", "v").where("u != v").distinct(), "edges")
    said = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("u").cast("decimal(38,0)"))).first()
        if seen == said or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select("v", "v").distinct().toDF("node", "root"))
        said, before = seen, path
        now, path = write_table(_star(_star(now, True), False), "edges")
        delete(edges.sparkSession, before)
