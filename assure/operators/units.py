"""Settlement units: a row for each order, every branch summed before it is joined; as-of rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assure.functions.money import apply_bps, sum_paise

# Statutory rates with the day from which they hold.
STATUTORY = (("TDS", "2024-10-01", None, 10, "GROSS"), ("TCS", "2024-07-10", None, 50, "NET_OF_RETURNS"), ("GST_ON_FEES", "2017-07-01", None, 1800, "FEE"))


def rate_book(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(STATUTORY, "kind string, since string, until string, bps int, basis string")
    return rows.select("kind", F.col("since").cast("date").alias("since"), F.col("until").cast("date").alias("until"), "bps", "basis")


def statutory(kind: str, day: Column, book=STATUTORY) -> Column:
    """The rate of a kind on a day; null before its first day. The book is a few literals."""
    out = F.lit(None).cast("int")
    for k, since, until, bps, _ in reversed(book):
        if k == kind:
            inside = day >= F.lit(since).cast("date")
            out = F.when(inside & (day <= F.lit(until).cast("date")) if until else inside, F.lit(bps)).otherwise(out)
    return out


def seller_card(orders: DataFrame, cards: DataFrame) -> DataFrame:
    """orders (k, seller, category, placed) with card_bps: of the cards in force on the day, the latest."""
    c = cards.select("seller", "category", F.col("bps").alias("card_bps"), "eff_from", "eff_to")
    on = (orders["seller"] == c["seller"]) & (orders["category"] == c["category"]) & (orders["placed"] >= c["eff_from"]) & (c["eff_to"].isNull() | (orders["placed"] <= c["eff_to"]))
    met = orders.join(c, on, "left").groupBy(orders["k"]).agg(F.max_by("card_bps", "eff_from").alias("card_bps"))
    return orders.join(met, "k")


def units(records, rate_as_of: str, banked: DataFrame) -> DataFrame:
    """One row an order: amounts of all its branches and how complete it is.

    records: plans.projection.Records or anything with its tables. banked: k of the orders with a bank leg.
    """
    intent, payment, transfer = records.table("intent"), records.table("payment"), records.table("transfer")
    day = F.lit(rate_as_of).cast("date")
    gst = statutory("GST_ON_FEES", day)
    pay = payment.groupBy(F.col("order_id").alias("k")).agg(
        F.count("*").alias("n_payments"), sum_paise("fee").alias("fee"), sum_paise("tax").alias("tax"), sum_paise(apply_bps("fee", gst)).alias("fee_gst")
    )
    of_payment = payment.select("payment_id", F.col("order_id").alias("k"))
    refunds = records.table("refund").join(of_payment, "payment_id").groupBy("k").agg(F.count("*").alias("n_refunds"), sum_paise("amount").alias("refunds"))
    disputes = records.table("dispute").join(of_payment, "payment_id").groupBy("k").agg(sum_paise("deducted").alias("disputes"))
    moved = transfer.join(of_payment, "payment_id")
    orphan = F.col("on_hold") & F.col("hold_until").isNull()
    holds = moved.groupBy("k").agg(sum_paise(F.when(orphan, F.col("amount"))).alias("orphaned"), F.count_if(orphan).alias("n_orphaned"))
    of_transfer = moved.select("transfer_id", "k")
    reversals = records.table("reversal").join(of_transfer, "transfer_id").groupBy("k").agg(F.count("*").alias("n_reversals"), sum_paise("amount").alias("reversals"))
    recons = records.table("recon").join(of_transfer, "transfer_id").groupBy("k").agg(F.count("*").alias("n_recons"), sum_paise("credit").alias("credit"), sum_paise("debit").alias("debit"))
    own = intent.select("k", "seller", "category", "placed", "gross", "applied_bps", "tcs", "tds")  # what checks and reports read
    rows = seller_card(own, records.table("rate_card"))
    for branch in (pay, refunds, disputes, holds, reversals, recons):
        rows = rows.join(branch, "k", "left")
    rows = rows.join(banked.select("k", F.lit(True).alias("bank")), "k", "left")
    rows = rows.fillna(0, [c for c in rows.columns if c in {"n_payments", "fee", "tax", "fee_gst", "n_refunds", "refunds", "disputes", "orphaned", "n_orphaned", "n_reversals", "reversals", "n_recons", "credit", "debit"}])
    complete = F.when(F.col("n_payments") == 0, "intent_only").when(F.col("bank"), "full").when(F.col("n_recons") > 0, "missing_bank").otherwise("missing_settlement")
    return rows.withColumn("completeness", complete)
