"""The scorer: links, findings and abstentions against seeded truth, one aggregate for each group of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assure.functions.money import ratio, sum_paise

from .close import facts


def scored_matches(groups: DataFrame, truth: DataFrame, found: DataFrame) -> DataFrame:
    """match_id, true_positive, silent of each group.

    groups: match_id, order, members (sorted array of leg keys); truth: order, legs (sorted array); found: order
    of everything with a finding or an exception. A group is right if its legs are exactly its order's; a wrong
    one that nothing points at is silent.
    """
    flagged = found.select("order").distinct().withColumn("flagged", F.lit(True))
    rows = groups.join(truth, "order", "left").join(flagged, "order", "left")
    right = F.coalesce(F.col("members") == F.col("legs"), F.lit(False))
    return rows.select("match_id", right.alias("true_positive"), (~right & F.col("flagged").isNull()).alias("silent"))


def scored_defects(injected: DataFrame, findings: DataFrame) -> DataFrame:
    """instance, order, defect, paise, detected, class_correct: of an order's findings the one of its class first, then the smallest id.

    injected: instance, order, defect, paise; findings: finding_id, order, found (its defect).
    """
    met = injected.join(findings, "order", "left").withColumn("same", F.coalesce(F.col("found") == F.col("defect"), F.lit(False)))
    best = F.row_number().over(W.partitionBy("instance").orderBy(F.desc("same"), F.asc_nulls_last("finding_id")))
    rows = met.withColumn("n", best).where("n = 1")
    return rows.select("instance", "order", "defect", "paise", F.col("finding_id").isNotNull().alias("detected"), F.col("same").alias("class_correct"))


def scored_abstentions(escalated: DataFrame, truth: DataFrame) -> DataFrame:
    """order, verdict: OVER where the data at hand would have resolved it, else CORRECT; one an order, the first exception's.

    escalated: rank, order; truth: order, resolvable.
    """
    first = escalated.groupBy("order").agg(F.min("rank").alias("rank"))
    return first.join(truth, "order").select("order", F.when(F.col("resolvable"), "OVER").otherwise("CORRECT").alias("verdict"))


def metrics(matches: DataFrame, defects: DataFrame, abstentions: DataFrame, findings: DataFrame, truth: DataFrame, resolutions: DataFrame) -> DataFrame:
    """metric, value (null: not measured).

    truth: order, resolvable, auto (whether its legs share one match); findings: paise, right (of an injected
    defect's class on its order); the others as the functions above return them; resolutions: outcome.
    """
    yes = lambda c: F.count_if(F.col(c))
    escalated = F.count_if(F.col("outcome") == "ESCALATED_UNRESOLVED")
    settled = F.count_if(F.col("outcome").isin("AUTO_RESOLVED", "PROPOSED"))
    t = truth.agg(F.count("*").alias("orders"), yes("auto").alias("auto"), yes("resolvable").alias("resolvable"))
    m = matches.agg(F.count("*").alias("groups"), yes("true_positive").alias("tp"), yes("silent").alias("silent"))
    d = defects.agg(F.count("*").alias("injected"), yes("detected").alias("detected"), yes("class_correct").alias("right"),
                    sum_paise(F.when(F.col("class_correct"), F.col("paise"))).alias("caught"), sum_paise(F.when(~F.col("detected"), F.col("paise"))).alias("missed"))
    f = findings.agg(F.count("*").alias("findings"), yes("right").alias("right_findings"), sum_paise(F.when(~F.col("right"), F.col("paise"))).alias("false_alarm"))
    a = abstentions.agg(F.count_if(F.col("verdict") == "OVER").alias("over"), F.count_if(F.col("verdict") == "CORRECT").alias("correct"))
    r = resolutions.agg(F.count("*").alias("resolutions"), escalated.alias("escalated"), settled.alias("resolved"))
    one = facts(t, m, d, f, a, r)
    c = F.col
    values = {
        "auto_match_rate": ratio("auto", "orders"), "match_precision": ratio("tp", "groups"), "match_recall": ratio("tp", "orders"),
        "silent_error_rate": ratio("silent", "groups"), "defect_recall": ratio("detected", "injected"), "defect_precision": ratio("right_findings", "findings"),
        "root_cause_accuracy": ratio("right", "detected"), "leakage_caught_inr": c("caught"), "leakage_missed_inr": c("missed"), "false_alarm_inr": c("false_alarm"),
        "correct_abstention_rate": ratio("correct", c("orders") - c("resolvable")), "over_abstention_rate": ratio("over", "resolvable"),
        "residual_resolution_rate": ratio("resolved", "resolutions"), "escalated_unresolved_rate": ratio("escalated", "resolutions"), "exceptions_total": c("resolutions"),
    }
    return one.select(*[v.cast("double").alias(k) for k, v in values.items()]).unpivot([], list(values), "metric", "value")


def determinism(observed: DataFrame, total: int) -> DataFrame:
    """score: the share of records whose hash is the same in all runs; null with fewer than two runs. observed: run, key, hash."""
    runs = observed.agg(F.count_distinct("run").alias("runs"))
    same = observed.groupBy("key").agg(F.count_distinct("hash").alias("n")).agg(F.count_if(F.col("n") == 1).alias("same"))
    return facts(runs, same).select(F.when(F.col("runs") >= 2, ratio("same", F.lit(total))).alias("score"))
