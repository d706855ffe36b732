"""Reports over a run's tables: a section of text for each exception, a summary, and variance bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assure.functions.money import format_inr

#: Characters of a full bar, and of the part that shows how deep in the band a difference is.
BAR, OVERHANG = 16, 4


def children(rows: DataFrame, parent: str, order: str, item: Column, name: str) -> DataFrame:
    """A list for each parent, in the order of a column: parent, name."""
    return rows.groupBy(parent).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x")))), lambda s: s["x"]).alias(name))


def exception_sections(exceptions: DataFrame, resolutions: DataFrame, evidence: DataFrame, steps: DataFrame) -> DataFrame:
    """rank, section: the text of every exception, none left out; readers sort by rank.

    exceptions: rank, origin, key, amount, reason. resolutions: key, outcome, claimed, downgrade_reason, tried, resolve.
    evidence: key, place, ref, role. steps: key, step_no, label, formula, output. Findings go by their key.
    """
    ev = children(evidence, "key", "place", F.concat(F.lit("`"), "ref", F.lit("` ("), "role", F.lit(")")), "refs")
    line = F.concat(F.lit("  "), F.col("step_no").cast("string"), F.lit(". "), "label", F.lit("\n       "), "formula", F.lit("\n       = "), F.col("output").cast("string"), F.lit(" paise"))
    tr = children(steps, "key", "step_no", line, "lines")
    rows = exceptions.join(resolutions, "key", "left").join(ev, "key", "left").join(tr, "key", "left")
    defect = F.when(F.col("origin") == "FINDING", F.col("reason")).otherwise("UNMATCHED")
    downgraded = F.when(F.col("downgrade_reason").isNotNull(), F.concat(F.lit(" (model claimed `"), "claimed", F.lit("`, downgraded: "), "downgrade_reason", F.lit(")"))).otherwise("")
    parts = [
        F.concat(F.lit("### `"), "key", F.lit("`  ·  "), defect, F.lit("  ·  "), format_inr("amount"), F.lit(" at risk")),
        F.concat(F.lit("| outcome | `"), F.coalesce("outcome", F.lit("NOT_MEASURED")), F.lit("`"), downgraded, F.lit(" |")),
        F.concat(F.lit("| what was tried | "), F.coalesce("tried", F.lit("")), F.lit(" |")),
        F.concat(F.lit("| what would resolve it | "), "resolve", F.lit(" |")),
        F.concat(F.lit("| evidence | "), F.array_join("refs", ", "), F.lit(" |")),
        F.concat(F.lit("recompute trace:\n"), F.array_join("lines", "\n")),
    ]
    return rows.select("rank", F.concat_ws("\n", *parts).alias("section"))


def header(exceptions: DataFrame, resolutions: DataFrame, gross: DataFrame) -> DataFrame:
    """One row of text: how many are escalated, at what amount, out of what was processed."""
    up = exceptions.join(resolutions.where("outcome = 'ESCALATED_UNRESOLVED'").select("key"), "key", "left_semi")
    sums = up.agg(F.count("*").alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).cast("long").alias("paise"))
    total = gross.agg(F.coalesce(F.sum("gross"), F.lit(0)).cast("long").alias("gross"))
    every = exceptions.agg(F.count("*").alias("all"))
    share = F.when(F.col("gross") > 0, F.round(F.col("paise") * 100.0 / F.col("gross"), 1)).otherwise(0.0)
    one = sums.join(total, how="cross").join(every, how="cross")  # three single rows
    return one.select(
        F.concat(F.col("n").cast("string"), F.lit(" escalated · "), format_inr("paise"), F.lit(" escalated · "), F.format_string("%.1f", share), F.lit("% of "), format_inr("gross"), F.lit(" processed")).alias("header"),
        F.concat(F.col("all").cast("string"), F.lit(" exceptions total, sorted by rupees at risk, no truncation.")).alias("note"),
    )


def overhang(delta, band) -> Column:
    """How deep in its band a shortfall is, from 0 to OVERHANG; halves go to the even number."""
    d, b = F.col(delta).cast("double"), F.col(band).cast("double")
    share = F.when(b != 0, F.least(F.lit(1.0), d / b)).otherwise(1.0)
    return F.when(d <= 0, 0).otherwise(F.bround(share * OVERHANG).cast("int"))


def variance_bar(delta, band) -> Column:
    """A solid bar, its overhang, and spaces up to one length for all rows."""
    n = overhang(delta, band)
    return F.concat(F.lit("█" * BAR), F.repeat(F.lit("▏"), n), F.repeat(F.lit(" "), F.lit(OVERHANG) - n))
