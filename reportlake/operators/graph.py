"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.session import cut, release

#: Rounds after which the search gives up; components of diameter d need about log d.
MAX_ROUNDS = 40


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the edges ``a, b`` (bigint).

    Each round takes the smallest label among a node and its neighbours, then the
    label of that label.  Labels are the only state; they are written to the shared
    checkpoint folder each round, and nothing but a count comes to the driver.  Self
    loops and repeated edges are harmless; no edges give no rows."""
    both = cut(
        edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct()
    )
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
        "node", F.least("node", "least").alias("component")
    )
    last = labels = cut(labels)
    for _ in range(MAX_ROUNDS):
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        stepped = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("component")
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = cut(
            stepped.join(jump, "component", "left").select(
                "node", "old", F.least("component", F.coalesce("further", "component")).alias("component")
            )
        )
        release(last)
        last, labels = moved, moved.select("node", "component")
        if moved.where("component <> old").isEmpty():
            release(both)
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
