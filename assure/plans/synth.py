"""A seeded workload: orders with their chains, injected defects and truth, of any size, in parallel.

Every choice is a hash of (seed, order, salt), so a workload is the same however it is partitioned. Tiers set
how messy it is: T1 clean, T2 with batches, splits, money in flight and unreadable narrations, T4 without defects.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assure.functions.money import apply_bps


@dataclass(frozen=True)
class Workload:
    orders: int = 200
    seed: int = 42
    sellers: int = 15
    unparseable_bps: int = 800
    in_flight_bps: int = 1500
    refund_bps: int = 1100
    defect_bps: int = 2000


TIERS = {
    "T1": {"unparseable_bps": 0, "in_flight_bps": 0},
    "T2": {"unparseable_bps": 2000, "in_flight_bps": 1500},
    "T4": {"unparseable_bps": 0, "in_flight_bps": 0, "defect_bps": 0},
}


def tiered(tier: str, **own) -> Workload:
    return Workload(**(TIERS[tier] | own))


def _dice(w: Workload, salt: str, sides: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(w.seed), F.col("id"), F.lit(salt)), F.lit(sides))


def world(spark: SparkSession, w: Workload = Workload()) -> DataFrame:
    """A row an order: its chain's amounts, the settlement's reference and credit, and the defect injected, if any."""
    rows = spark.range(1, w.orders + 1)
    defect = F.when(_dice(w, "defect", 10_000) < w.defect_bps, F.element_at(F.array(*[F.lit(d) for d in ("D01", "D02", "D04", "D05", "D08")]), (_dice(w, "kind", 5) + 1).cast("int")))
    rows = rows.select(
        "id", (_dice(w, "seller", w.sellers) + 1).alias("seller"), (_dice(w, "gross", 1_000_000) + 500_000).alias("gross_paise"),
        F.date_sub(F.lit("2026-08-20").cast("date"), (_dice(w, "age", 45) + 20).cast("int")).alias("placed"),
        F.when(_dice(w, "refund", 10_000) < w.refund_bps, _dice(w, "refunded", 100_000) + 1000).otherwise(0).alias("refund_paise"), defect.alias("defect"),
        (_dice(w, "narration", 10_000) >= w.unparseable_bps).alias("readable"), (_dice(w, "flight", 10_000) < w.in_flight_bps).alias("in_flight"),
    )
    card = (F.lit(1000) + F.pmod(F.col("seller"), F.lit(7)) * 50).cast("long")
    rows = rows.withColumn("card_bps", card).withColumn("applied_bps", F.when(F.col("defect") == "D01", card + 100).otherwise(card))
    rows = rows.withColumn("fee_paise", apply_bps("gross_paise", F.lit(180))).withColumn("tax_paise", apply_bps("fee_paise", F.when(F.col("defect") == "D08", 1200).otherwise(1800)))
    rows = rows.withColumn("tcs_paise", apply_bps(F.col("gross_paise") - F.when(F.col("defect") == "D04", F.lit(0)).otherwise(F.col("refund_paise")), F.lit(50)))
    rows = rows.withColumn("tcs_paise", F.when((F.col("defect") == "D04") & (F.col("refund_paise") == 0), F.col("tcs_paise") + 300).otherwise(F.col("tcs_paise")))
    rows = rows.withColumn("tds_paise", F.when(F.col("defect") == "D05", F.lit(0).cast("long")).otherwise(apply_bps("gross_paise", F.lit(10))))
    net = F.col("gross_paise") - apply_bps("gross_paise", card) - F.col("fee_paise") - F.col("refund_paise")
    rows = rows.withColumn("net_paise", net).withColumn("credit_paise", F.when(F.col("defect") == "D02", net - 50).otherwise(net))
    return rows.withColumn("utr", F.upper(F.substring(F.md5(F.concat_ws("-", F.lit(w.seed).cast("string"), F.col("id").cast("string"))), 1, 16)))


def found_in(rows: DataFrame) -> DataFrame:
    """id, defect of what checking a world finds: the same arithmetic, blind to what was injected."""
    hits = F.array_compact(
        F.array(
            F.when(apply_bps("gross_paise", "applied_bps") != apply_bps("gross_paise", "card_bps"), "D01"),
            F.when((F.col("net_paise") > F.col("credit_paise")) & (F.col("net_paise") - F.col("credit_paise") <= F.greatest(F.lit(100), apply_bps("net_paise", F.lit(10)))), "D02"),
            F.when(F.col("tcs_paise") != apply_bps(F.col("gross_paise") - F.col("refund_paise"), F.lit(50)), "D04"),
            F.when(F.col("tds_paise") != apply_bps("gross_paise", F.lit(10)), "D05"),
            F.when(F.col("tax_paise") != apply_bps("fee_paise", F.lit(1800)), "D08"),
        )
    )
    return rows.select("id", F.explode(hits).alias("found"))
