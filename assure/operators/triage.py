"""The exception queue, its gates, the rules-only arm, budgets and terminal states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assure.sources.readers import numbered

#: A resolution stays automatic below this amount and from this confidence on.
AUTO_BELOW_PAISE, AUTO_FROM_BPS = 10_000, 9_000
BATCH_BUDGET = 60_000
# Outcomes from best to worst; the worst of a record is its terminal state.
OUTCOMES = ("VERIFIED_CLEAN", "AUTO_RESOLVED", "PROPOSED", "ESCALATED_UNRESOLVED")


def queue(unmatched: DataFrame, ambiguous: DataFrame, findings: DataFrame) -> DataFrame:
    """rank, origin, key, amount, reason: most money first, then by key, then in the order of the three inputs.

    unmatched and ambiguous: key, amount, reason; findings: key (the finding's id), amount, reason. The queue is
    what people read, exceptions only; it is ranked in one sort.
    """
    parts = [
        df.select(F.lit(origin).alias("origin"), F.lit(n).alias("source"), "key", "amount", "reason")
        for n, (origin, df) in enumerate((("UNMATCHED", unmatched), ("UNMATCHED", ambiguous), ("FINDING", findings)))
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return ranked(rows, [F.desc("amount"), F.asc("key"), F.asc("source"), F.asc("reason")]).drop("source")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank from 1 in a total order: sorted by ranges, each counted on from those before it."""
    return numbered(rows, *order).withColumnRenamed("line_no", "rank")


def downgraded(resolutions: DataFrame) -> DataFrame:
    """resolutions (outcome, amount, confidence_bps) with final_outcome and downgrade_reason; the amount is tested first."""
    auto = F.col("outcome") == "AUTO_RESOLVED"
    reason = F.when(auto & (F.col("amount") >= AUTO_BELOW_PAISE), "amount").when(auto & (F.col("confidence_bps") < AUTO_FROM_BPS), "confidence")
    return resolutions.withColumn("downgrade_reason", reason).withColumn("final_outcome", F.when(reason.isNotNull(), "PROPOSED").otherwise(F.col("outcome")))


class FabricationError(Exception):
    """Evidence cites a record that was never ingested."""


def fabricated(evidence: DataFrame, index: DataFrame) -> DataFrame:
    """The rows of evidence (key) whose key is in no record: must be empty."""
    return evidence.join(index.select("key").distinct(), "key", "left_anti")


def assert_grounded(evidence: DataFrame, index: DataFrame) -> None:
    bad = fabricated(evidence, index).limit(5).collect()
    if bad:
        raise FabricationError(", ".join(r["key"] for r in bad))


def rules_only(exceptions: DataFrame) -> DataFrame:
    """Every exception escalated with a fixed text: the arm without a model."""
    return exceptions.select(
        "rank", "key", "amount", F.lit("ESCALATED_UNRESOLVED").alias("outcome"), F.lit(0).alias("confidence_bps"), F.lit("rules_only").alias("stop_reason"),
        F.lit("a person compares the cited records").alias("what_would_resolve_it"),
    )


def within_budget(spent: DataFrame, budget: int = BATCH_BUDGET) -> DataFrame:
    """spent (rank, tokens) with before and investigated: an entry runs while earlier ones have spent less than the budget."""
    block = F.shiftright("rank", 12)  # sums run within blocks of ranks; only block totals meet in one task
    totals = spent.groupBy(block.alias("_b")).agg(F.sum("tokens").alias("_t"))
    offset = totals.select("_b", F.coalesce(F.sum("_t").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inside = F.coalesce(F.sum("tokens").over(W.partitionBy(block).orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = spent.withColumn("_i", inside).withColumn("_b", block).join(offset, "_b")
    rows = rows.withColumn("before", (F.col("_i") + F.col("_o")).cast("long")).drop("_i", "_b", "_o")
    return rows.withColumn("investigated", F.col("before") < budget)


def terminal_states(records: DataFrame, outcomes: DataFrame) -> DataFrame:
    """key, state: the worst outcome of each record, clean without one. outcomes: key, outcome."""
    rank = F.array_position(F.array(*[F.lit(o) for o in OUTCOMES]), F.col("outcome"))
    worst = outcomes.groupBy("key").agg(F.max(rank).alias("w"))
    state = F.element_at(F.array(*[F.lit(o) for o in OUTCOMES]), F.coalesce("w", F.lit(1)).cast("int"))
    return records.join(worst, "key", "left").select("key", state.alias("state"))


def lookups(records, subjects: DataFrame) -> DataFrame:
    """Evidence of many exceptions at once: for each k its payments, transfers, refunds, disputes and recon rows, counted.

    One join a tool, each against rows summed by order before, instead of a call for each exception.
    """
    of_payment = records.table("payment").select("payment_id", F.col("order_id").alias("k"))
    of_transfer = records.table("transfer").join(of_payment, "payment_id").select("transfer_id", "k")
    out = subjects.select("k")
    for name, rows in (
        ("payments", of_payment), ("transfers", of_transfer), ("refunds", records.table("refund").join(of_payment, "payment_id")),
        ("disputes", records.table("dispute").join(of_payment, "payment_id")), ("recons", records.table("recon").join(of_transfer, "transfer_id")),
    ):
        out = out.join(rows.groupBy("k").agg(F.count("*").alias(name)), "k", "left").fillna(0, [name])
    return out


def recons_on(records, day: str) -> DataFrame:
    """The settlement rows of one day."""
    return records.table("recon").where(F.col("settled") == F.lit(day).cast("date"))
