"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) of each node in edges (a, b); loops and repeated edges do no harm.

    Every round takes the least label around each node and then the label of that label, so paths halve. A
    node's labels meet in a minimum, which Spark combines before the shuffle: a hub is no hot key.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    for _ in range(rounds):
        near = (
            both.join(label.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        stepped = label.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("root").alias("next"))
        moved = stored(stepped.join(jump, "low").select("node", "root", F.least("low", "next").alias("new")))
        label = moved.select("node", F.col("new").alias("root"))
        if moved.where("new <> root").isEmpty():
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")
