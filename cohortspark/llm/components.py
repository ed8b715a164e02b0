"""Connected components of a link table, by contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (u, v): label is one node of its component, the same for all.

    Each round sends every node to that neighbour, or itself, whose hash of this round is the smallest, and contracts. The node with the largest hash of a
    component always vanishes, so the rounds end; hashes anew each round make a constant share vanish on average, whatever the shape (a path as well).
    """
    edges = materialise(links.select("u", "v").filter("u <> v").distinct())
    chain: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = both.unionByName(edges.select("u", F.col("u").alias("v"))).unionByName(edges.select(F.col("v").alias("u"), "v"))
        parent = materialise(both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", F.lit(len(chain))).alias("h"), "v"))["v"].alias("p")))
        chain.append(parent)
        up = lambda e, c: e.join(parent.withColumnRenamed("u", c), c).drop(c).withColumnRenamed("p", c)  # noqa: E731, B023
        edges = materialise(up(up(edges, "u"), "v").filter("u <> v").distinct())
    if not chain:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    label = chain[0].select(F.col("u").alias("node"), F.col("p").alias("label"))
    for parent in chain[1:]:
        nxt = parent.select(F.col("u").alias("label"), "p")
        label = label.join(nxt, "label", "left").select("node", F.coalesce("p", "label").alias("label"))
    return label
