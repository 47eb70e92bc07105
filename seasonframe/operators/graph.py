"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import materialized


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) of every node of the links ``a``, ``b`` (whole numbers), the root being its component's least node.

    Each round points every node's greater neighbours at its least one, then the node itself; both sides of a
    link that is a node's own are left out. A node's neighbours are reduced to a minimum, never gathered, so a node
    that holds a third of the links is spread like any other. Rounds are about the logarithm of the component's size.
    """
    links = links.select(F.greatest("a", "b").cast("long").alias("hi"), F.least("a", "b").cast("long").alias("lo"))
    nodes = materialized(links.select(F.col("hi").alias("node")).union(links.select("lo")).filter(F.col("node").isNotNull()).distinct())
    links, seen = materialized(links.filter("hi > lo").distinct()), None
    for _ in range(max_rounds):
        ends = links.select(F.col("hi").alias("at"), F.col("lo").alias("to")).union(links.select("lo", "hi"))
        least = ends.groupBy("at").agg(F.least(F.min("to"), F.first("at")).alias("least"))
        larger = ends.filter("to > at").join(least, "at").select(F.col("to").alias("hi"), F.col("least").alias("lo")).distinct()
        least = larger.groupBy("hi").agg(F.min("lo").alias("least"))
        smaller = larger.join(least, "hi")
        smaller = smaller.filter("lo > least").select(F.col("lo").alias("hi"), F.col("least").alias("lo")).union(smaller.select("hi", F.col("least").alias("lo")))
        links = materialized(smaller.filter("hi > lo").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == seen:
            return nodes.join(links.select(F.col("hi").alias("node"), "lo"), "node", "left").select("node", F.coalesce("lo", "node").alias("root"))
        seen = now
    raise RuntimeError(f"components not found in {max_rounds} rounds")
