"""Connected components of an edge table, by minimum labels and pointer jumps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deleted, written


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of edges; label: the smallest node that it is joined with.

    Every round each node takes the smallest label among its own and its neighbours', then its label's label, so that
    long chains shrink by more than half. A round is one written table; nothing is collected but the count of changes.
    Edges with a null end are left out; no edges give an empty table."""
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("near")).where(F.col("node").isNotNull() & F.col("near").isNotNull() & (F.col("node") != F.col("near")))
    both = written(both.union(both.select(F.col("near"), F.col("node"))).distinct(), "edges")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("near"), F.col("label").alias("of")), "near")
        least = near.groupBy("node").agg(F.min("of").alias("of"))
        # what the neighbours know reaches the node and, by its old label, the whole tree below that label
        step = labels.join(least, "node", "left").select("node", "label", F.least(F.col("label"), F.coalesce("of", "label")).alias("new"))
        roots = step.groupBy("label").agg(F.min("new").alias("root"))
        step = step.join(roots, "label").select("node", "label", F.least("new", "root").alias("new"))
        step = written(step, "step")
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("top"))
        changed = written(step.join(jump, "new", "left").select("node", F.col("label").alias("old"), F.least(F.col("new"), F.coalesce("top", "new")).alias("label")), "labels")
        for old in (labels, step):
            deleted(edges.sparkSession, old._written)
        labels = changed.select("node", "label")
        labels._written = changed._written
        if not changed.where("old != label").limit(1).count():
            return labels
    raise RuntimeError(f"components: not settled after {most_rounds} rounds")
