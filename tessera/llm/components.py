"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import publish


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node in ``edges (u, v)``; the label is the component's smallest node.

    Each round every node points to its smallest neighbour or itself, pointers
    are doubled until they reach a root, and the edges are rewritten to roots;
    loops and repeats go.  The edges left shrink at least by half of the nodes
    a round.  Group minima are aggregated before the shuffle; each round's
    tables are written to the shared folder.
    """
    left = publish(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    labels = None
    while left.head(1):
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = publish(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")), "cc-up")
        while True:
            deeper = up.where("p <> u").select(F.col("u").alias("p"), F.col("p").alias("pp"))
            moved = up.join(deeper, "p")  # nodes whose parent is no root yet
            if not moved.head(1):
                break
            up = publish(up.join(deeper, "p", "left").select("u", F.coalesce("pp", "p").alias("p")), "cc-up")
        if labels is None:
            labels = up.select(F.col("u").alias("node"), F.col("p").alias("label"))
        else:
            labels = publish(labels.join(up.withColumnRenamed("u", "label"), "label", "left").select(
                "node", F.coalesce("p", "label").alias("label")), "cc-labels")
        a, b = up.select("u", F.col("p").alias("pu")), up.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        left = publish(left.join(a, "u").join(b, "v").where("pu <> pv").select(
            F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct(), "cc-edges")
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).limit(0)
    return labels
