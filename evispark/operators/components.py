"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.shared import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (node, component) for every node of an edge; component is the least node that links reach.

    Self-edges count as nodes alone; null ends are ignored; repeated edges are one. Each round rewrites
    the edge list as stars around the least neighbour, so path lengths shrink geometrically; a star's
    rows are combined with min() before they are shuffled, so a hub does not fill one task. Rounds end
    when one changes nothing, which they come to however long the paths are.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    now = materialize(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before, changed = state(now), True
    while changed and before[0]:
        # Large star: every greater neighbour of a node is tied to the node's least neighbour.
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        big = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # Small star: every lesser neighbour, and the node, is tied to the least of them.
        least = big.groupBy("a").agg(F.min("b").alias("low"))
        small = big.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b")))
        now = materialize(small.where("a <> b").distinct(), "edges")
        after = state(now)
        before, changed = after, after != before
    return nodes.join(now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
