"""Connected components by repeated contraction, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wadi.llm.storage import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): the least node that each can reach.

    Each round points every node at its least neighbour, follows the pointers
    once more and contracts the links; a round at least halves the nodes that
    are left. Loops and repeated links do no harm; no links give no rows. Each
    round's tables are files, so the plan stays short, joins on a hub can be
    split, and a round's files go with the next.
    """
    links = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    labels = cut(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("component", F.col("node")))
    while links.limit(1).count():
        near = links.union(links.select("b", "a")).groupBy("a").agg(F.min("b").alias("b"))
        near = cut(near.select("a", F.least("a", "b").alias("p")))
        further = near.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        parents = cut(near.join(further, "p", "left").select("a", F.coalesce("pp", "p").alias("p")))
        old = labels, links, near, parents
        labels = cut(labels.join(parents.withColumnRenamed("a", "component"), "component", "left").select("node", F.coalesce("p", "component").alias("component")))
        left = links.join(parents, "a").select(F.col("p").alias("x"), "b")
        both = left.join(parents.withColumnRenamed("a", "b"), "b").select(F.col("x").alias("a"), F.col("p").alias("b"))
        links = cut(both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        drop(*old)
    drop(links)
    return labels
