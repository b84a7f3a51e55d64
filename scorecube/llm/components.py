"""Connected components of a link table, as a loop of Spark joins over a shrinking graph.

In a round every node that has a neighbour of lower hash hooks onto the lowest one, and the links are rewritten to the nodes hooked
onto; links inside a node, and repeated ones, go. As hashes are in no order along the links, a round leaves a fixed share
of the nodes. Tables are written
each round: that cuts the lineage, and a join of two written tables is one whose hot keys Spark can split
(adaptive skew join), while the least-neighbour aggregate combines before its shuffle. A node with a third of all links
thus never meets one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _ranked(column: str):
    """A node by its hash: in no order along a path, whatever the nodes are."""
    return F.struct(F.xxhash64(column).alias("rank"), F.col(column).alias("to"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link to another; component is a node of the same component, one for all.
    Rows with a null end are ignored; repeated links and links of a node to itself do no harm; no links give no rows."""
    ends = F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.struct(F.col(b).alias("a"), F.col(a).alias("b")))
    edges = written(links.select(F.inline(ends)).where("a <> b").distinct())
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    while not edges.isEmpty():
        low = F.least(_ranked("a"), F.min(_ranked("b")))
        hook = written(edges.groupBy("a").agg(low.alias("low")).select("a", F.col("low.to").alias("to")))
        other = hook.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        edges = written(edges.join(hook, "a").join(other, "b")
                            .select(F.col("to").alias("a"), F.col("to_b").alias("b")).where("a <> b").distinct())
        labels = labels.join(hook.withColumnRenamed("a", "component"), "component", "left").select(
            "node", F.coalesce("to", "component").alias("component"))
    return written(labels)
