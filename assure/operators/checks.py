"""The eight checks, as column expressions over units: what each needs, when it applies, fires, and at what risk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assure.functions.dates import age_days
from assure.functions.money import Tolerance, apply_bps, severity

from .units import statutory

ALL = ("full", "missing_bank", "missing_settlement", "intent_only")
SETTLED = ("full", "missing_bank")
HOLD_DAYS = 14


@dataclass(frozen=True)
class Step:
    """A line of the arithmetic: the formula is SQL over its inputs, and gives the output."""

    label: str
    formula: str
    inputs: tuple[str, ...]


@dataclass(frozen=True)
class Check:
    defect: str
    requires: tuple[str, ...]
    applies: Column
    fires: Column
    amount: Column
    conclusion: str
    steps: tuple[Step, ...]
    evidence: tuple[str, ...]


def _bps(a: str, b: str) -> str:
    return f"(CASE WHEN ({a}) < 0 THEN -1 ELSE 1 END * ((ABS({a}) * ({b}) + 5000) div 10000))"


def amounts(units: DataFrame, rate_as_of: str) -> DataFrame:
    """units with what the checks compare: the entitlement et, what was netted, rates of the day."""
    day = F.lit(rate_as_of).cast("date")
    rate = F.coalesce("card_bps", "applied_bps")
    rows = units.withColumns({"tds_bps": statutory("TDS", day), "tcs_bps": statutory("TCS", day), "gst_bps": statutory("GST_ON_FEES", day)})
    rows = rows.withColumn("et", F.col("gross") - apply_bps("gross", rate) - F.col("fee"))
    rows = rows.withColumn("expected", F.col("et") - F.least(F.col("refunds") + F.col("disputes"), F.col("et")))
    rows = rows.withColumn("actual", F.col("credit") - F.col("debit"))
    disputed = F.least("disputes", "et")
    rows = rows.withColumn("netting", disputed + F.greatest(F.lit(0).cast("long"), F.least(F.col("refunds"), F.col("et") - disputed)))
    return rows


def checks(as_of: str, tolerance: Tolerance = Tolerance()) -> tuple[Check, ...]:
    c = F.col
    drift = F.abs(apply_bps("gross", "applied_bps") - apply_bps("gross", "card_bps"))
    short = c("expected") - c("actual")
    under = c("netting") - c("debit")
    tcs = F.abs(c("tcs") - apply_bps(c("gross") - c("refunds"), "tcs_bps"))
    tds = F.abs(c("tds") - apply_bps("gross", "tds_bps"))
    gst = F.abs(c("tax") - c("fee_gst"))
    always = F.lit(True)
    return (
        Check("D01", ALL, c("card_bps").isNotNull(), (c("card_bps") != c("applied_bps")) & (drift > 0), drift, "commission at another rate than the card's",
              (Step("commission applied", _bps("gross", "applied_bps"), ("gross", "applied_bps")), Step("commission on the card", _bps("gross", "card_bps"), ("gross", "card_bps")),
               Step("drift", f"ABS({_bps('gross', 'applied_bps')} - {_bps('gross', 'card_bps')})", ("gross", "applied_bps", "card_bps"))), ("order", "intent", "rate_card")),
        Check("D02", SETTLED, c("n_recons") > 0, (short > 0) & tolerance.within("expected", "actual"), short, "short settlement inside the tolerance",
              (Step("expected", "expected", ("expected",)), Step("actual", "credit - debit", ("credit", "debit")), Step("short", "expected - (credit - debit)", ("expected", "credit", "debit"))), ("order", "recon_row")),
        Check("D03", SETTLED, (c("n_recons") > 0) & (c("n_refunds") > 0), under > 0, under, "refund not netted in full",
              (Step("to net", "netting", ("netting",)), Step("not netted", "netting - debit", ("netting", "debit"))), ("order", "refund", "recon_row")),
        Check("D04", ALL, c("tcs_bps").isNotNull(), tcs > 0, tcs, "TCS on another basis than net of returns",
              (Step("TCS due", _bps("gross - refunds", "tcs_bps"), ("gross", "refunds", "tcs_bps")), Step("difference", f"ABS(tcs - {_bps('gross - refunds', 'tcs_bps')})", ("tcs", "gross", "refunds", "tcs_bps"))), ("order", "intent")),
        Check("D05", ALL, c("tds_bps").isNotNull(), tds > 0, tds, "TDS at another rate or basis",
              (Step("TDS due", _bps("gross", "tds_bps"), ("gross", "tds_bps")), Step("difference", f"ABS(tds - {_bps('gross', 'tds_bps')})", ("tds", "gross", "tds_bps"))), ("order", "intent")),
        Check("D06", ("missing_settlement",), c("n_orphaned") > 0, age_days(F.lit(as_of), "placed") >= HOLD_DAYS, c("orphaned"), "hold without a release date",
              (Step("held", "orphaned", ("orphaned",)),), ("order", "transfer")),
        Check("D07", SETTLED, c("n_reversals") > 0, c("n_refunds") == 0, c("reversals"), "reversal without a refund",
              (Step("reversed", "reversals", ("reversals",)),), ("order", "reversal")),
        Check("D08", ("full", "missing_bank", "missing_settlement"), (c("n_payments") > 0) & c("gst_bps").isNotNull(), gst > 0, gst, "GST on the fee at another slab",
              (Step("GST due", "fee_gst", ("fee_gst",)), Step("difference", "ABS(tax - fee_gst)", ("tax", "fee_gst"))), ("order", "payment")),
    )


def _verdict(s: Check) -> tuple[Column, Column]:
    """Why a check is skipped, or null; and whether it fires."""
    gate = F.col("completeness").isin(*s.requires)
    skipped = F.when(~gate, F.concat(F.lit("completeness="), "completeness", F.lit(" not in requires"))).when(~F.coalesce(s.applies, F.lit(False)), F.lit("applies_to() declined"))
    return skipped, gate & F.coalesce(s.applies, F.lit(False)) & F.coalesce(s.fires, F.lit(False))


def evaluated(rows: DataFrame, specs: tuple[Check, ...]) -> DataFrame:
    """k, defect, skipped (a reason or null), fired, amount: one pass over the units for all checks."""
    verdicts = []
    for s in specs:
        skipped, fired = _verdict(s)
        verdicts.append(F.struct(F.lit(s.defect).alias("defect"), skipped.alias("skipped"), fired.alias("fired"), s.amount.alias("amount")))
    return rows.select("k", "completeness", F.explode(F.array(*verdicts)).alias("v")).select("k", "completeness", "v.*")


def findings(rows: DataFrame, specs: tuple[Check, ...]) -> DataFrame:
    """k, defect, amount, severity of what fired: one pass, in which checks that don't fire make no row."""
    fired = F.array_compact(F.array(*[F.when(_verdict(s)[1], F.struct(F.lit(s.defect).alias("defect"), s.amount.alias("amount"))) for s in specs]))
    return rows.select("k", F.explode(fired).alias("v")).select("k", "v.defect", "v.amount").withColumn("severity", severity("amount"))


def trace(rows: DataFrame, specs: tuple[Check, ...]) -> DataFrame:
    """k, defect, step_no, label, formula, output of the arithmetic behind each finding."""
    every = F.array(
        *[
            F.struct(F.lit(s.defect).alias("defect"), F.lit(n).alias("step_no"), F.lit(step.label).alias("label"), F.lit(step.formula).alias("formula"), F.expr(step.formula).cast("long").alias("output"))
            for s in specs
            for n, step in enumerate(s.steps, 1)
        ]
    )
    fired = findings(rows, specs).select("k", "defect")
    steps = rows.select("k", F.explode(every).alias("s")).select("k", "s.*")
    return steps.join(fired, ["k", "defect"])


def evidence(found: DataFrame, specs: tuple[Check, ...]) -> DataFrame:
    """k, defect, role: which kinds of records a finding rests on."""
    roles = F.create_map(*[x for s in specs for x in (F.lit(s.defect), F.array(*[F.lit(r) for r in s.evidence]))])
    return found.select("k", "defect", F.explode(roles[F.col("defect")]).alias("role"))


def skip_tally(rows: DataFrame, specs: tuple[Check, ...]) -> DataFrame:
    """defect, reason, n of what was not evaluated."""
    return evaluated(rows, specs).where("skipped is not null").groupBy("defect", F.col("skipped").alias("reason")).agg(F.count("*").alias("n"))
