"""One synchronous round of hash propagation over a graph held as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash60


def propagate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, h) after a round: a node's hash with those of its operands (node, pos, pred), in order of position.

    A commutative node takes its operands' hashes in order of value instead. Nodes without operands keep theirs.
    """
    operands = edges.join(nodes.select(F.col("node").alias("pred"), F.col("h").alias("ph")), "pred")
    gathered = operands.groupBy("node").agg(F.collect_list(F.struct("pos", "ph")).alias("p"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    by_pos = text(F.transform(F.array_sort("p"), lambda x: x["ph"]))
    by_value = text(F.array_sort(F.transform("p", lambda x: x["ph"])))
    out = nodes.join(gathered, "node", "left")
    new = hash60(F.concat_ws("|", F.col("h").cast("string"), F.when(F.col("commutative"), by_value).otherwise(by_pos)))
    return out.select("node", F.when(F.col("p").isNull(), F.col("h")).otherwise(new).alias("h"))
