"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatecount.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for every node of `edges` (a, b: longs).

    Each round takes the smallest label among the neighbours, then the label's label, and is written to the shared
    folder, so that lineage stays short and no executor holds the only copy. A path of n nodes takes about log n rounds.
    """
    edges = edges.where("a <> b").select("a", "b")
    both = written(edges.unionByName(edges.selectExpr("b as a", "a as b")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("lower"))
        jump = labels.select(F.col("node").alias("lower"), F.col("label").alias("beyond"))
        after = written(
            lower.join(jump, "lower").select("node", F.col("label").alias("before"), F.least("lower", "beyond").alias("label")),
            "labels",
        )
        labels = after.select("node", "label")
        if after.where("label <> before").isEmpty():
            return labels
