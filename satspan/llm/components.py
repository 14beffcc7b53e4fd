"""Connected components of an edge table, as Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satspan.llm.common import materialize


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``edges(a, b)`` to ``(id, component)``, the smallest id reachable.

    Each round takes the least label of the neighbours and then the label of
    that label (pointer jumping), so the rounds grow with the logarithm of the
    longest path. Every round is written to the shared folder. No group is
    collected: a hub's edges meet partial minima only.
    """
    both = materialize(
        edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{label}-edges"
    )
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least("a", F.min("b")).alias("component")), label)
    while True:
        near = (
            both.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        )
        step = labels.join(near, "id").select(
            "id", F.col("component").alias("old"), F.least("component", "near").alias("up")
        )
        jump = labels.select(F.col("id").alias("up"), F.col("component").alias("top"))
        nxt = materialize(
            step.join(jump, "up").select("id", "old", F.least("up", "top").alias("component")), label
        )
        labels = nxt.select("id", "component")
        if nxt.where("old <> component").isEmpty():
            return labels
