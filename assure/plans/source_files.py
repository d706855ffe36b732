"""The four source files of a run, as a platform would export them: written from canonical tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assure.functions.money import div
from assure.sources.readers import ARRAYS, COLUMNS


def _rupees(paise: str) -> Column:
    """Rupees that the readers take back as they are: the fraction counts upwards from the whole part."""
    p = F.col(paise)
    whole = div(p - F.pmod(p, F.lit(100)), 100)
    return F.concat(whole.cast("string"), F.lit("."), F.lpad(F.pmod(p, F.lit(100)).cast("string"), 2, "0"))


def _seconds(day: str) -> Column:
    return F.unix_date(day).cast("long") * 86_400


def _id(prefix: str, number: str) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.col(number).cast("string"))


def _csv(rows: DataFrame, path: str, name: str, *order: str) -> None:
    """One file with a header: one task writes it, row by row, since the format is one file."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*COLUMNS[name]).coalesce(1).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write(records, folder: str) -> None:
    """sellers, intent, bank (CSV) and razorpay (JSON) in folder, each in the order of its keys."""
    blank = F.lit("")
    card = records.table("rate_card")
    sellers = card.select(_id("sel", "seller").alias("seller_id"), F.concat(F.lit("Seller "), F.col("seller").cast("string")).alias("seller_name"), "category", F.col("bps").alias("commission_bps"),
                          F.col("eff_from").alias("effective_from"), F.col("eff_to").alias("effective_to"), F.col("ver").alias("version"), "seller", "eff_from")
    _csv(sellers, f"{folder}/sellers.csv", "sellers", "seller", "category", "eff_from")
    i = records.table("intent")
    intent = i.select(
        "k", _id("order", "k").alias("order_id"), F.concat(F.lit("Seller "), F.col("seller").cast("string")).alias("seller_name"), "category", _rupees("gross").alias("gross_amount"), blank.alias("taxable_value"), blank.alias("gst_amount"),
        F.concat(F.col("placed").cast("string"), F.lit(" 12:00:00")).alias("placed_at_ist"), F.col("st").alias("status"), F.lit("N").alias("is_interstate"), _rupees("commission").alias("expected_commission"),
        F.col("applied_bps").alias("commission_rate_bps"), _rupees("tcs").alias("expected_tcs"), _rupees("tds").alias("expected_tds"), F.lit("v1").alias("rate_card_version"),
    )
    _csv(intent, f"{folder}/intent.csv", "intent", "k")
    narration = F.when(F.col("utr").isNotNull(), F.concat(F.lit("UTR:"), "utr", F.lit(" PLATFORM SETTLEMENT"))).otherwise("CREDIT RECEIVED MISC")
    bank = records.table("bank").select("bank_id", _id("bank", "bank_id").alias("bank_ref"), _rupees("amount").alias("credit"), blank.alias("debit"), F.col("credited").cast("string").alias("value_date"), narration.alias("narration"))
    _csv(bank, f"{folder}/bank.csv", "bank", "bank_id")
    _processor(records, f"{folder}/razorpay.json")


def _processor(records, path: str) -> None:
    t = records.table
    arrays = {
        "payments": t("payment").select(F.col("payment_id").alias("n"), F.struct(_id("pay", "payment_id").alias("id"), _id("order", "order_id").alias("order_id"), "amount", F.lit("INR").alias("currency"), "method", F.lit("captured").alias("status"), _seconds("captured").alias("captured_at"), "fee", "tax").alias("e")),
        "transfers": t("transfer").select(F.col("transfer_id").alias("n"), F.struct(_id("trf", "transfer_id").alias("id"), _id("pay", "payment_id").alias("payment_id"), F.lit("acc").alias("recipient"), "amount", "on_hold", _seconds("hold_until").alias("on_hold_until"), _seconds("settled").alias("settled_at")).alias("e")),
        "refunds": t("refund").select(F.col("refund_id").alias("n"), F.struct(_id("rfnd", "refund_id").alias("id"), _id("pay", "payment_id").alias("payment_id"), "amount", _seconds("created").alias("created_at")).alias("e")),
        "reversals": t("reversal").select(F.col("reversal_id").alias("n"), F.struct(_id("rvsl", "reversal_id").alias("id"), _id("trf", "transfer_id").alias("transfer_id"), "amount", _seconds("created").alias("created_at")).alias("e")),
        "disputes": t("dispute").select(F.col("dispute_id").alias("n"), F.struct(_id("disp", "dispute_id").alias("id"), _id("pay", "payment_id").alias("payment_id"), "amount", "status", F.col("deducted").alias("deducted_amount")).alias("e")),
        "settlements": t("recon").select(F.col("recon_id").alias("n"), F.struct(_id("rcn", "recon_id").alias("id"), _id("trf", "transfer_id").alias("entity_id"), F.lit("transfer").alias("entity_type"), _id("setl", "settlement_id").alias("settlement_id"), "utr",
                                                                            (F.col("credit") - F.col("debit")).alias("amount"), F.lit(0).alias("fee"), F.lit(0).alias("tax"), "debit", "credit", _seconds("settled").alias("settled_at")).alias("e")),
    }
    parts = []
    for a, kind in enumerate(ARRAYS):
        rows = arrays[kind]
        parts.append(rows.select(F.lit(a).alias("a"), "n", F.concat(F.to_json("e"), F.lit(",")).alias("value")))
        ends = [(a, -1, ("{" if a == 0 else "") + f'"{kind}": ['), (a, None, "null]" + ("}" if a == len(ARRAYS) - 1 else ","))]  # a null element takes the last comma
        parts.append(rows.sparkSession.createDataFrame(ends, "a int, n long, value string"))
    order = ["a", F.asc_nulls_last("n")]
    reduce(DataFrame.unionByName, parts).repartitionByRange(*order).sortWithinPartitions(*order).select("value").coalesce(1).write.text(path)
