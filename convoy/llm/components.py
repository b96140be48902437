"""Connected components over links, by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoy.llm.shared import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of links with the smallest node that it reaches.

    Both steps are hash aggregations of a node's neighbours to their minimum and one join
    back; a node with many neighbours is a minimum over many rows, never a list. Each round
    is written to the shared folder. Links that are doubled, reversed or to oneself do no harm.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    while True:
        # Large star: each node links its larger neighbours to the smallest of its neighbours and itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node links its smaller neighbours and itself to the smallest of them.
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "components")
        # Done when every node has one link, and no link's lower end has one of its own.
        nodes = after.groupBy("u").count()
        many = nodes.where("count > 1").limit(1).count()
        if not many and not after.join(after.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            roots = after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        edges = after
