"""A whole run as a committed folder: its canonical tables, groups, units, findings, exceptions and states."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assure.functions.text import record_key
from assure.oracles import BANK_NODE
from assure.operators import checks, triage
from assure.plans import runstore
from assure.plans.projection import AS_OF
from assure.sources.readers import numbered
from assure.sources.shared import checkpoint_dir

CANONICAL = ("intent", "payment", "refund", "transfer", "reversal", "dispute", "recon", "bank", "rate_card")


def tables(run) -> dict[str, DataFrame]:
    """Name to rows of each table of a run, in the order in which they are written."""
    found = numbered(run.findings.withColumn("unit_id", record_key("unit", "k")), "unit_id", "defect")
    found = found.select(record_key("find", "line_no").alias("finding_id"), "unit_id", "k", "defect", "severity", F.col("amount").alias("amount_at_risk_paise"))
    outcomes = run.findings.select(record_key("ord", "k").alias("key"), F.lit("ESCALATED_UNRESOLVED").alias("outcome"))
    queue = run.queue.select(
        record_key("exc", "rank").alias("exception_id"), "origin", F.when(F.col("origin") == "UNMATCHED", F.col("key")).alias("record_key"),
        F.when(F.col("origin") == "FINDING", F.col("key")).alias("finding_ref"), F.col("amount").alias("amount_at_risk_paise"), F.col("rank").alias("queue_rank"),
    )
    return {name: run.t(name) for name in CANONICAL} | {
        "match_group": run.groups,
        "settlement_unit": run.units.select(record_key("unit", "k").alias("unit_id"), "k", "seller", F.date_format("placed", "yyyy-MM").alias("period"), "completeness"),
        "finding": found,
        "finding_evidence": checks.evidence(run.findings, run.specs).distinct(),
        "exception": queue,
        "record_terminal_state": triage.terminal_states(run.t("intent").select(record_key("ord", "k").alias("key")), outcomes),
    }


def match_member(run, groups: DataFrame) -> DataFrame:
    """match_id, key, side of each record in a group: of its chain's orders and of the credit that a pass attached."""
    groups = groups.select("match_id", "component")
    claimed = run.linked.groups.where("bank_id IS NOT NULL").select(F.col("pending_id").alias("component"), "bank_id").distinct()
    order_of = run.chains.withColumnRenamed("node", "n")

    def side(rows: DataFrame, node: Column, name: str, prefix: str, number: str) -> DataFrame:
        return rows.select(node.alias("n"), record_key(prefix, number).alias("key"), F.lit(name).alias("side"))

    placed = reduce(DataFrame.unionByName, [
        side(run.t("intent"), F.col("k"), "intent", "int", "k"), side(run.placed_payment, F.col("order_id"), "razorpay", "pay", "payment_id"),
        side(run.placed_recon, F.col("transfer_id"), "razorpay", "rcn", "recon_id"), side(run.t("bank"), F.col("bank_id") + F.lit(BANK_NODE), "bank", "bank", "bank_id"),
    ])
    own = placed.join(order_of, "n").join(groups, "component").select("match_id", "key", "side")
    late = claimed.join(groups, "component").select("match_id", record_key("bank", "bank_id").alias("key"), F.lit("bank").alias("side"))
    return own.unionByName(late).distinct()


def checks_of(made: dict[str, DataFrame]) -> tuple[DataFrame, ...]:
    """What must be empty before a run is committed."""
    from assure.operators import constraints as c

    both = (F.col("origin") == "UNMATCHED") == F.col("record_key").isNotNull()
    return (
        c.unique("finding_id", made["finding"], "finding_id"), c.foreign_key("finding_unit", made["finding"], "unit_id", made["settlement_unit"], "unit_id"),
        c.unique("match_id", made["match_group"], "match_id"), c.holds("exception_origin", made["exception"], both, "exception_id"),
        c.unique("terminal_state", made["record_terminal_state"], "key"), c.unique("rate_card_period", made["rate_card"], "seller", "category", "eff_from"),
    )


def commit(run, run_dir: str, sample_label: str = "HELD_OUT", dirty: bool = False, more: Mapping[str, DataFrame] = {}, started_at: float | None = None) -> None:
    """A run's tables, and what more it has, written and committed; the manifest holds the times if it is told the start."""
    made = tables(run) | dict(more)
    manifest = {"sample_label": sample_label, "git_dirty": dirty, "rate_as_of": AS_OF, "tables": sorted(made)}
    if started_at is not None:
        manifest["started_at"] = int(started_at)
    runstore.commit(run.spark, run_dir, made, manifest, checks_of(made))


def investigated(run, found, cites: DataFrame) -> dict[str, DataFrame]:
    """The further tables of a run whose exceptions were investigated, as scoring reads them. cites: finding_ref, key, role."""
    return {
        "match_member": match_member(run, run.groups), "finding_evidence_key": cites,
        "resolution": found.resolutions.select("rank", "key", "amount", "outcome", "confidence_bps", "n_hypotheses", "chosen", "tried", "resolve", "stop_reason", "iterations", "tokens"),
        "resolution_evidence": found.resolutions.select("rank", F.explode("refs").alias("key")), "agent_call": found.calls,
    }


def committed(run) -> DataFrame:
    """name, n of each table of a run that has been committed and opened again."""
    run_dir = f"{checkpoint_dir(run.spark)}/run-{uuid.uuid4().hex}"
    commit(run, run_dir)
    manifest, _ = runstore.opened(run.spark, run_dir)
    counts = [run.spark.read.parquet(f"{run_dir}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name in manifest["tables"]]
    return reduce(DataFrame.unionByName, counts)
