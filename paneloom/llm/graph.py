"""Connected components over an edge table, as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.session import Scratch


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(id, label): label is the smallest id reachable over edges (a, b). Ids without an edge have no row.

    Each round gives every node the smallest label among its neighbours and follows labels one step further, so
    chains halve. Each round is written to the shared folder, which cuts lineage and survives lost executors.
    Sums are taken map-side first, so a node with very many edges does not gather in one task.
    """
    both = scratch.keep(edges.select("a", "b").where("a != b").distinct().selectExpr("inline(array(struct(a as x, b as y), struct(b as x, a as y)))"), "edges")
    labels = scratch.keep(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("id"), F.least("x", "m").alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("id").alias("y"), F.col("label").alias("ly")), "y").groupBy("x").agg(F.min("ly").alias("m"))
        step = labels.join(near, labels["id"] == near["x"]).select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        nxt = scratch.keep(step.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        changed = nxt.where("label != old").limit(1).count()
        scratch.drop(labels)
        labels = nxt.select("id", "label")
        labels._paneloom_path = nxt._paneloom_path
        if not changed:
            scratch.drop(both)
            return labels
    raise RuntimeError("components did not settle")
