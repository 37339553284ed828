"""Connected components of a large edge list by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowndate.llm.frames import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b): the label is the smallest node that links lead to.

    A round gives every node the smallest label around it, summed on the map side, and then the label of its label, so
    chains shorten by half or better. Each round's labels are written to the shared folder; only a count of changes
    comes back. A self-loop keeps a node without links.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        offered = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("offer")
        )
        nearer = labels.join(offered, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "offer").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = written(
            nearer.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        )
        changed = after.filter("label <> old").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels
