"""Connected components of a table of links, by alternating large and small stars.

No part of the graph comes to the driver or to one task: each step is a grouped minimum (combined
before it is shuffled) and a join on the node. Steps are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.llm.workspace import Workspace


def _star(edges: DataFrame) -> DataFrame:
    """Link every neighbour of a node to the smallest node next to it; ``edges`` has both directions where wanted."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least, "u")


def connected_components(links: DataFrame, space: Workspace, name: str = "cc", most: int = 40) -> DataFrame:
    """``node, component`` of every node that has a link; ``links`` has columns ``a`` and ``b`` of longs.

    The component is its smallest node. Links of a node with itself and repeated links do no harm.
    """
    edges = space.table(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    before = None
    for step in range(1, most + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _star(large)
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        now = space.table(small, f"{name}-{step}")
        # done when every node has one link and none links to a node that has a link itself
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        same, before, edges = state == before, state, now
        if step > 1:
            space.drop(f"{name}-{step - 2}") if step > 2 else None
        if same:
            break
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
