"""Connected components over shared values: the least node of each value, and rounds of minima where a node has several values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assure.sources.shared import checkpoint_dir, written


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component (the smallest node reachable) from edges (node BIGINT, value): equal values join nodes.

    A null value joins nothing. Nodes of one value take its least node, in one shuffle by node and one by value. Rounds are made only
    over nodes of several values and the least nodes of these values; chains longer than `rounds` are an error, never a silent stop.
    """
    checkpoint_dir(edges.sparkSession)
    alone = edges.groupBy("node").agg(F.count("value").alias("n")).where("n = 0").select("node", F.col("node").alias("component"))
    known = edges.where(F.col("value").isNotNull()).select("node", "value").repartition("node").distinct()
    placed = known.withColumn("n", F.count("*").over(W.partitionBy("node"))).withColumn("low", F.min("node").over(W.partitionBy("value")))
    placed = written(placed)
    joints = placed.where("n > 1")
    if joints.isEmpty():
        return placed.select("node", F.col("low").alias("component")).unionByName(alone)
    least = placed.select(F.col("low").alias("node"), "value").join(joints.select("value"), "value", "left_semi").select("node", "value")
    label = _settled(joints.select("node", "value").unionByName(least).distinct(), rounds)
    own = placed.select("node", F.when(F.col("n") > 1, F.col("node")).otherwise(F.col("low")).alias("of")).distinct()
    met = own.join(label.withColumnRenamed("node", "of"), "of", "left")
    return met.select("node", F.coalesce("component", "of").alias("component")).unionByName(alone)


def _settled(known: DataFrame, rounds: int) -> DataFrame:
    """node, component of distinct edges without nulls: each round is a minimum by value and one by node, both combined before the shuffle."""
    known = known.checkpoint()
    label = known.select("node").distinct().withColumn("component", F.col("node")).checkpoint()
    for _ in range(rounds):
        low = known.join(label, "node").groupBy("value").agg(F.min("component").alias("low"))
        near = known.join(low, "value").groupBy("node").agg(F.min("low").alias("low"))
        new = label.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "low").alias("component"))
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = new.join(jump, "component").select("node", "was", F.least("component", "next").alias("component")).checkpoint()
        label = new.select("node", "component")
        if new.where("was <> component").isEmpty():
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")
