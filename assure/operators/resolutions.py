"""Resolutions of exceptions: their invariants, what grounds them, their content hash, and which keys may be cited."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prefixes of records that hang on an order but are no leg of a settlement; hints of forced stops.
SATELLITES = ("rfnd_", "disp_", "rvsl_", "oln_")
HINTS = {
    "iteration_cap": "more investigation -- the 8-iteration cap was reached before a conclusion could be drawn",
    "budget_exhausted": "more token budget -- the per-exception budget was exhausted before a conclusion could be drawn",
    "tool_failure": "a working data source -- a tool call needed for the investigation could not be completed",
}

NOTHING_TRIED = "the investigation was stopped before any tool call completed"


def broken(r: Column) -> Column:
    """Names of the invariants that a resolution, as a struct of the columns of violations(), breaks: an array."""
    rules = {
        "escalation_needs_hint": (r["outcome"] == "ESCALATED_UNRESOLVED") & (F.coalesce(r["resolve"], F.lit("")) == ""),
        "two_hypotheses": ~r["trivial"] & (r["n_hypotheses"] < 2),
        "chosen_in_range": r["chosen"].isNotNull() & ~r["chosen"].between(0, r["n_hypotheses"] - 1),
        "evidence": r["n_evidence"] < 1,
        "confidence": ~r["confidence_bps"].between(0, 10_000),
    }
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())


def violations(resolutions: DataFrame) -> DataFrame:
    """key, rule of each invariant that a resolution breaks.

    resolutions: key, outcome, confidence_bps, n_hypotheses, chosen (0-based, or null), n_evidence, resolve, trivial.
    """
    return resolutions.select("key", F.explode(broken(F.struct(*[c for c in resolutions.columns if c != "key"]))).alias("rule"))


def grounded(exceptions: DataFrame, gathered: DataFrame, of_findings: DataFrame) -> DataFrame:
    """key, grounds, refs: what an escalation cites: what was gathered, else the finding's evidence, else its own record.

    exceptions: key, origin, record_key; gathered and of_findings: key, ref. grounds is null where nothing can be cited.
    """

    def lists(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("key").agg(F.array_sort(F.collect_set("ref")).alias(name))

    rows = exceptions.join(lists(gathered, "g"), "key", "left").join(lists(of_findings, "f"), "key", "left")
    found = F.when(F.col("origin") == "FINDING", F.col("f"))
    grounds = F.when(F.col("g").isNotNull(), "gathered").when(found.isNotNull(), "finding").when(F.col("record_key").isNotNull(), "subject")
    return rows.select("key", grounds.alias("grounds"), F.coalesce("g", found, F.when(F.col("record_key").isNotNull(), F.array("record_key"))).alias("refs"))


def forced(exceptions: DataFrame, stop_reason: str) -> DataFrame:
    """The escalation of each exception (key, amount) that a stop forces; the amount is the exception's own."""
    return exceptions.select(
        "key", "amount", F.lit("ESCALATED_UNRESOLVED").alias("outcome"), F.lit(0).alias("confidence_bps"), F.lit(stop_reason).alias("stop_reason"),
        F.lit(NOTHING_TRIED).alias("tried"), F.lit(HINTS[stop_reason]).alias("resolve"), F.lit(True).alias("trivial"),
    )


def content_hash(*columns: str) -> Column:
    """sha256 of the meaning of a resolution: names and values in order of name, no generated ids."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in sorted(columns)]
    return F.sha2(F.concat_ws("\n", *parts), 256)


def is_settlement_identity(key: str) -> Column:
    """Whether a key claims to be a leg of a settlement: no satellite of an order. Orders are taken out by an anti join."""
    return ~reduce(Column.__or__, [F.startswith(F.col(key), F.lit(p)) for p in SATELLITES])


def closure(truth: DataFrame) -> DataFrame:
    """member, order: the order itself and each of its legs. truth: order, legs (JSON array of keys)."""
    legs = truth.select("order", F.explode(F.from_json("legs", "array<string>")).alias("member"))
    return truth.select(F.col("order").alias("member"), "order").unionByName(legs).distinct()


def fabricated(cited: DataFrame, orders: DataFrame, truth: DataFrame, index: DataFrame) -> DataFrame:
    """key, oracle of each cited key that is made up: identities must be in a closure, all others in the record index.

    cited: key, claims (whether it is cited as a member or a subject); orders: key; truth: member; index: key.
    """
    keys = cited.join(orders.select("key", F.lit(True).alias("_order")), "key", "left")
    identity = F.col("claims") & F.col("_order").isNull() & is_settlement_identity("key")
    keys = keys.select("key", identity.alias("identity")).distinct()
    lost = keys.where("identity").join(truth.select(F.col("member").alias("key")), "key", "left_anti").select("key", F.lit("truth").alias("oracle"))
    return lost.unionByName(keys.where("not identity").join(index.select("key"), "key", "left_anti").select("key", F.lit("index").alias("oracle")))


def by_record(exceptions: DataFrame, evidence: DataFrame) -> DataFrame:
    """key, rank: the exception of each record, the last in the queue where several name it.

    exceptions: rank, origin, key, record_key; evidence: key, ref.
    """
    own = exceptions.where("origin = 'UNMATCHED' AND record_key IS NOT NULL").select(F.col("record_key").alias("key"), "rank")
    cited = exceptions.where("origin = 'FINDING'").join(evidence, "key").select(F.col("ref").alias("key"), "rank")
    return own.unionByName(cited).groupBy("key").agg(F.max("rank").alias("rank"))
