"""The playbook: what to look up for an exception of each kind, and what to submit then, as a table of answers without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assure.functions.text import record_key
from assure.sources.replay import RESPONSE

#: Kind of exception to the lookups of each turn; after the last one it submits.
LOOKUPS = {
    "D01": (("search_intent_ledger", "fetch_rate_card"),), "D02": (("fetch_payment", "fetch_transfer"),), "D03": (("fetch_payment",), ("fetch_refunds_for_payment",)),
    "D04": (("search_intent_ledger",),), "D05": (("search_intent_ledger",),), "D06": (("fetch_transfer",),), "D07": (("fetch_transfer",),), "D08": (("fetch_payment", "fetch_dispute"),),
    "UNMATCHED": (("fetch_settlement_recon",),),
}
#: Tool to the argument that is left out where the exception has no such record, and further ones.
_ARGS = {
    "search_intent_ledger": ("order_id",), "fetch_rate_card": ("seller_id", "as_of"), "fetch_payment": ("payment_id",), "fetch_transfer": ("transfer_id",),
    "fetch_refunds_for_payment": ("payment_id",), "fetch_dispute": ("dispute_id",), "fetch_settlement_recon": ("date",),
}
SURE_BPS = 8_000


def subjects(run) -> DataFrame:
    """key of each exception with the ids that its lookups take; null where there is none."""
    first = lambda rows, by, number, prefix, name: rows.groupBy(by).agg(record_key(prefix, F.min(number)).alias(name))
    payment = run.t("payment").where("order_id IS NOT NULL")
    of_order = payment.select("payment_id", F.col("order_id").alias("k"))
    ids = (
        run.t("intent").select("k", record_key("ord", "k").alias("order_id"), record_key("sell", "seller").alias("seller_id"), F.col("placed").cast("string").alias("as_of"))
        .join(first(of_order, "k", "payment_id", "pay", "payment_id"), "k", "left")
        .join(first(run.t("transfer").join(of_order, "payment_id"), "k", "transfer_id", "trf", "transfer_id"), "k", "left")
        .join(first(run.t("dispute").join(of_order, "payment_id"), "k", "dispute_id", "disp", "dispute_id"), "k", "left").drop("k")
    )
    exceptions = run.queue.select("key", F.when(F.col("origin") == "FINDING", F.col("reason")).otherwise("UNMATCHED").alias("kind")).distinct()
    days = run.t("bank").select(record_key("bank", "bank_id").alias("key"), F.col("credited").cast("string").alias("date"))
    rows = exceptions.withColumn("order_id", F.when(F.col("kind") != "UNMATCHED", F.substring_index("key", "/", -1)))
    return rows.join(ids, "order_id", "left").join(days, "key", "left")


def _answer(text: str, calls: Column, submit: Column) -> Column:
    return F.struct(F.lit(text).alias("text"), calls.alias("calls"), submit.alias("submit"), F.lit(0).alias("tokens_in"), F.lit(0).alias("tokens_out")).cast(RESPONSE)


def script(run) -> DataFrame:
    """key, turn, response for every exception of a run's queue."""
    who = subjects(run)
    no_submit = F.lit(None).cast("struct<outcome:string,confidence_bps:int,hypotheses:array<string>,chosen:int,evidence:array<struct<ref:string,role:string>>,tried:string,resolve:string,trivial:boolean>")
    turns: list[Column] = []
    for kind, rounds in LOOKUPS.items():
        answers = [(n, _answer(f"{kind}: look", F.array(*[_call(tool) for tool in names]), no_submit)) for n, names in enumerate(rounds, 1)]
        answers.append((len(rounds) + 1, _answer(f"{kind}: submit", F.array().cast("array<struct<name:string,args:map<string,string>>>"), _submission(kind))))
        turns.append(F.when(F.col("kind") == kind, F.array(*[F.struct(F.lit(n).alias("turn"), a.alias("response")) for n, a in answers])))
    return who.select("key", F.explode(F.coalesce(*turns)).alias("t")).select("key", "t.turn", "t.response")


def _call(tool: str) -> Column:
    given = F.map_filter(F.create_map(*[x for n in _ARGS[tool] for x in (F.lit(n), F.col(n))]), lambda _, v: v.isNotNull())
    return F.struct(F.lit(tool).alias("name"), given.alias("args"))


def _submission(kind: str) -> Column:
    """A finding is proposed for correction; a record that nothing matches is escalated with what would settle it."""
    loose = kind == "UNMATCHED"
    ref = F.when(F.lit(loose), F.col("key")).otherwise(F.col("order_id"))
    return F.struct(
        F.lit("ESCALATED_UNRESOLVED" if loose else "PROPOSED").alias("outcome"), F.lit(0 if loose else SURE_BPS).alias("confidence_bps"),
        F.array(F.lit("the recomputed amount is right"), F.lit("an input of the recomputation is wrong")).alias("hypotheses"), F.lit(None if loose else 0).cast("int").alias("chosen"),
        F.array(F.struct(ref.alias("ref"), F.lit("exception_subject").alias("role"))).alias("evidence"), F.lit(", ".join(t for names in LOOKUPS[kind] for t in names)).alias("tried"),
        F.lit("the remitter's advice for this credit" if loose else None).cast("string").alias("resolve"), F.lit(False).alias("trivial"),
    )
