"""The close: cash waterfall, holds and their age, and the header of the exception list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assure.functions.dates import age_days
from assure.functions.money import format_inr, ratio, sum_paise


def _sums(df: DataFrame, **columns: str) -> DataFrame:
    return df.agg(*[sum_paise(c).alias(name) for name, c in columns.items()])


def facts(*parts: DataFrame) -> DataFrame:
    """The columns of several single-row tables of whole numbers in one row."""
    rows = reduce(DataFrame.unionByName, [p.unpivot([], p.columns, "name", "value") for p in parts])
    return rows.agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for p in parts for c in p.columns])


def waterfall(records) -> DataFrame:
    """measure, paise: what was sold, every deduction, what should settle, and where it is. One aggregate a table."""
    transfer = records.table("transfer")
    where = F.when(F.col("on_hold") & F.col("hold_until").isNull(), "held").when(F.col("settled").isNotNull(), "settled").otherwise("in_flight")
    parts = (
        _sums(records.table("intent"), gross="gross", commission="commission", tcs="tcs", tds="tds"),
        _sums(records.table("payment"), fees="fee", gst="tax"), _sums(records.table("refund"), refunds="amount"),
        _sums(records.table("reversal"), reversals="amount"), _sums(records.table("dispute"), disputes="deducted"),
        transfer.withColumn("where", where).agg(*[sum_paise(F.when(F.col("where") == w, F.col("amount"))).alias(w) for w in ("held", "settled", "in_flight")]),
    )
    rows = reduce(DataFrame.unionByName, [p.unpivot([], p.columns, "measure", "paise") for p in parts])
    sign = F.when(F.col("measure") == "gross", 1).when(F.col("measure").isin("held", "settled", "in_flight"), 0).otherwise(-1)
    return rows.unionByName(rows.agg(sum_paise(F.col("paise") * sign).alias("paise")).withColumn("measure", F.lit("expected_settleable")))


def held_age(records, as_of: str) -> DataFrame:
    """n, paise, max_age_days of holds without a release date."""
    held = records.table("transfer").where("on_hold and hold_until is null").join(
        records.table("payment").select("payment_id", F.col("order_id").alias("k")), "payment_id"
    ).join(records.table("intent").select("k", "placed"), "k")
    return held.agg(F.count("*").alias("n"), sum_paise("amount").alias("paise"), F.max(age_days(F.lit(as_of), "placed")).cast("long").alias("max_age_days"))


def exceptions_header(resolutions: DataFrame, intent: DataFrame) -> DataFrame:
    """escalated, escalated_paise, share: what was escalated and its share of the money processed."""
    up = resolutions.where("outcome = 'ESCALATED_UNRESOLVED'").agg(F.count("*").alias("escalated"), sum_paise("amount").alias("escalated_paise"))
    return facts(up, _sums(intent, gross="gross")).select("escalated", "escalated_paise", ratio("escalated_paise", "gross").alias("share"))


def close_text(rows: DataFrame) -> str:
    """The waterfall as Markdown; its rows are as many as its measures."""
    lines = [f"| {r['measure']} | {r['inr']} |" for r in rows.select("measure", format_inr("paise").alias("inr")).collect()]
    return "\n".join(["| measure | amount |", "|---|---:|", *lines]) + "\n"
