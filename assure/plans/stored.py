"""A stored run read again: its groups, findings, exceptions and resolutions against truth, and two runs against each other.

Groups are judged by counts over their members, never as arrays, so a group of any size is summed in parts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assure.functions.money import ratio
from assure.functions.text import record_key
from assure.operators.resolutions import SATELLITES, content_hash
from assure.plans import runstore, score
from assure.plans.close import facts


@dataclass(frozen=True)
class Truth:
    """legs: order, member (each in one order); orders: order, resolvable; injected: instance, order, defect, paise. order is a key."""

    legs: DataFrame
    orders: DataFrame
    injected: DataFrame


class StoredRun:
    """The tables of a committed run's folder; opening one without a manifest raises."""

    def __init__(self, spark: SparkSession, run_dir: str, allow_dirty: bool = False):
        self.spark, self.run_dir = spark, run_dir
        self.manifest, self.stamp = runstore.opened(spark, run_dir, allow_dirty)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.run_dir}/{name}")

    def findings(self) -> DataFrame:
        """finding_id, order, found, paise."""
        return self.table("finding").select("finding_id", record_key("ord", "k").alias("order"), F.col("defect").alias("found"), F.col("amount_at_risk_paise").alias("paise"))

    def cited(self) -> DataFrame:
        """key of every record that an exception names: its own, or those its finding cites."""
        x = self.table("exception")
        own = x.where("origin = 'UNMATCHED'").select(F.col("record_key").alias("key"))
        return own.unionByName(self.table("finding_evidence_key").join(x.where("origin = 'FINDING'").select("finding_ref"), "finding_ref", "left_semi").select("key")).distinct()

    def seconds(self) -> int | None:
        """Whole seconds from the first stage to the last, as the manifest has them."""
        times = self.manifest.get("started_at"), self.manifest.get("finished_at")
        return None if None in times else int(times[1]) - int(times[0])


def scored_matches(run: StoredRun, truth: Truth) -> DataFrame:
    """match_id, true_positive, silent of each group.

    Right: its members, without orders and what hangs on them, are all legs of one order, and as many as that order has. A wrong one
    is silent if no order's unit in it has a finding and no exception cites one of its members. No member at all: wrong.
    """
    members = run.table("match_member")
    identity = members.where(~reduce(lambda a, b: a | b, [F.col("key").startswith(p) for p in (*SATELLITES, "ord_")]))
    size = truth.legs.groupBy("order").agg(F.count_distinct("member").alias("legs"))
    met = identity.select("match_id", "key").distinct().join(truth.legs.select(F.col("member").alias("key"), "order").distinct(), "key", "left")
    met = met.join(run.cited().withColumn("cited", F.lit(True)), "key", "left")
    judged = met.groupBy("match_id").agg(F.count("*").alias("n"), F.count("order").alias("known"), F.min("order").alias("order"), F.max("order").alias("last"), F.max("cited").alias("cited"))
    found = run.table("finding").select(record_key("int", "k").alias("key")).distinct()
    flagged = members.join(found, "key", "left_semi").select("match_id").distinct().withColumn("found", F.lit(True))
    rows = run.table("match_group").select("match_id").join(judged, "match_id", "left").join(size, "order", "left").join(flagged, "match_id", "left")
    right = F.coalesce((F.col("n") == F.col("known")) & (F.col("order") == F.col("last")) & (F.col("n") == F.col("legs")), F.lit(False))
    return rows.select("match_id", right.alias("true_positive"), (~right & F.col("cited").isNull() & F.col("found").isNull()).alias("silent"))


def auto_matched(run: StoredRun, truth: Truth) -> DataFrame:
    """order, resolvable, auto: whether all its legs are in one and the same group; of several groups of a leg the last counts."""
    one = run.table("match_member").groupBy(F.col("key").alias("member")).agg(F.max("match_id").alias("match_id"))
    legs = truth.legs.distinct().join(one, "member", "left").groupBy("order").agg((F.count("match_id") == F.count("*")).alias("all"), (F.min("match_id") == F.max("match_id")).alias("same"))
    return truth.orders.join(legs, "order", "left").select("order", "resolvable", F.coalesce(F.col("all") & F.col("same"), F.lit(False)).alias("auto"))


def metrics(run: StoredRun, truth: Truth, repeated: DataFrame | None = None) -> DataFrame:
    """metric, value of the 23 metrics; null: not measured. repeated: run, key, hash of several runs (observed())."""
    findings = run.findings()
    seeded = truth.injected.select("order", F.col("defect").alias("found"), F.lit(True).alias("right")).distinct()
    judged = findings.join(seeded, ["order", "found"], "left").select("paise", F.coalesce("right", F.lit(False)).alias("right"))
    x = run.table("exception").where("origin = 'FINDING'").select(F.col("queue_rank").alias("rank"), F.substring_index("finding_ref", "/", -1).alias("order"))
    resolved = run.table("resolution").select("outcome")
    base = score.metrics(scored_matches(run, truth), score.scored_defects(truth.injected, findings.drop("paise")), score.scored_abstentions(x, truth.orders), judged, auto_matched(run, truth), resolved)
    outcome = lambda o: F.count_if(F.col("outcome") == o)
    counts = resolved.agg(outcome("AUTO_RESOLVED").alias("auto_resolved_count"), outcome("PROPOSED").alias("proposed_count"), outcome("ESCALATED_UNRESOLVED").alias("escalated_unresolved_count"))
    tokens = run.table("agent_call").agg(F.coalesce(F.sum(F.col("tokens_in") + F.col("tokens_out")), F.lit(0)).alias("tokens"))
    total = truth.orders.agg(F.count("*").alias("orders"))
    same = score.determinism(repeated, total.head()[0]) if repeated is not None else counts.select(F.lit(None).cast("double").alias("score"))
    seconds = F.lit(run.seconds()).cast("double")
    more = {
        "records_per_second": F.when(seconds > 0, F.col("orders") / seconds), "wall_clock_seconds_total": seconds, "llm_tokens_per_1000_records": ratio("tokens", "orders") * 1000,
        "inr_cost_per_1000_records": F.lit(None), "determinism_score": F.col("score"), **{c: F.col(c) for c in counts.columns},
    }
    rest = facts(counts, tokens, total, same).select(*[v.cast("double").alias(k) for k, v in more.items()]).unpivot([], list(more), "metric", "value")
    return base.unionByName(rest)


def observed(runs: list[StoredRun]) -> DataFrame:
    """run, key, hash of what each run made of each exception: key and place in the queue, amount, outcome, and its text."""
    parts = []
    for n, run in enumerate(runs, 1):
        x = run.table("exception").select(F.coalesce("record_key", "finding_ref").alias("subject"), F.col("amount_at_risk_paise").cast("string").alias("paise"), F.col("queue_rank").alias("rank"))
        rows = x.join(run.table("resolution").select("rank", "outcome", F.col("confidence_bps").cast("string").alias("bps"), "stop_reason"), "rank")
        key = F.concat_ws("#", F.col("rank").cast("string"), "subject")
        parts.append(rows.select(F.lit(n).alias("run"), key.alias("key"), content_hash("subject", "paise", "outcome", "bps", "stop_reason").alias("hash")))
    return reduce(DataFrame.unionByName, parts)
