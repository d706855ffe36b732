"""Chains that wait for their bank credit, as a stream: an extension beside the batch passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of a folder, a bounded number a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(path)


def credited(chains: DataFrame, credits: DataFrame, wait: str = "30 days") -> DataFrame:
    """Chains (utr, settled_at, target_paise) with the credit (utr, credited_at, amount_paise) that arrives within `wait`; null where none does.

    Both sides carry watermarks, so the state of a chain goes once its credit can no longer come.
    """
    c = chains.withWatermark("settled_at", "1 day").alias("c")
    b = credits.withWatermark("credited_at", "1 day").alias("b")
    inside = F.expr(f"b.credited_at >= c.settled_at AND b.credited_at <= c.settled_at + INTERVAL {wait}")
    met = c.join(b, (F.col("c.utr") == F.col("b.utr")) & inside, "left_outer")
    return met.select("c.utr", "c.settled_at", "c.target_paise", "b.credited_at", "b.amount_paise")


def daily_credits(credits: DataFrame) -> DataFrame:
    """day, n, paise of credits as they arrive; late ones count for a day."""
    day = F.window("credited_at", "1 day")
    return credits.withWatermark("credited_at", "1 day").groupBy(day).agg(F.count("*").alias("n"), F.sum("amount_paise").alias("paise")).select(F.col("window.start").alias("day"), "n", "paise")
