"""Connected components of links between ids, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for all nodes of links(a, b): root is the smallest node reachable.

    Each round takes the least label among a node and its neighbours, then the label of that
    label, and is written out; rounds end when no label changes. All joins are by key on long
    columns, so that a node with very many links is split by the engine's skew handling, and sums are made before the shuffle.
    """
    links = links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    both = scratch.keep(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"), F.lit(True).alias("changed")))
    while not labels.where("changed").isEmpty():
        known = labels.select("node", "root")
        near = both.join(known.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        new = scratch.keep(known.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "m").alias("root"), F.col("root").alias("old")))
        far = new.select(F.col("node").alias("at"), F.col("root").alias("further"))
        root = F.least("root", "further")
        jumped = scratch.keep(new.join(far, F.col("root") == F.col("at")).select("node", root.alias("root"), (root < F.col("old")).alias("changed")))
        scratch.drop(new, labels)
        labels = jumped
    scratch.drop(both)
    return labels.select("node", "root")
