"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.plans.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components", most_rounds: int = 100) -> DataFrame:
    """edges: a, b. Returns node, label (the smallest node of its component) for every node of an edge.

    Each round takes the smallest label among a node's neighbours (a map-side combined aggregate, so a hub costs a task one row a
    partition) and then jumps to the label's own label, which halves long chains. Rounds are written to shared storage, two at a
    time; the loop ends when no label changed. Rows with a null end are no edges; loops and repeated edges are harmless."""
    both = edges.where("a is not null and b is not null").select("a", "b")
    both = scratch.write(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), f"{name}-0")
    for i in range(1, most_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        stepped = stepped.join(jump, "label").select("node", "old", F.least("label", "further").alias("label"))
        stepped = scratch.write(stepped, f"{name}-{i}")
        changed = not stepped.where("label <> old").isEmpty()
        scratch.drop(f"{name}-{i - 1}")
        labels = stepped.select("node", "label")
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
