"""Normalisers: raw rows to canonical columns, with a quarantine reason and a lineage of what changed.

A normaliser is one select; rows without a reason are valid, the others are quarantined, none is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assure.functions.dates import epoch_to_utc, ist_midnight_to_utc, ist_to_utc, utc_text
from assure.functions.money import paise_of_rupees
from assure.functions.text import extract_utr

REASON = "normalise_failed"


@dataclass(frozen=True)
class Field:
    """A canonical column: its source column, its value (null: malformed), and the rule that made it."""

    name: str
    source: str
    value: Column
    rule: str
    required: bool = True


def intent_fields() -> tuple[Field, ...]:
    return (
        Field("gross_paise", "gross_amount", paise_of_rupees("gross_amount"), "rupees_to_paise"),
        Field("placed_at_utc", "placed_at_ist", ist_to_utc("placed_at_ist"), "ist_to_utc"),
        Field("is_interstate", "is_interstate", F.col("is_interstate") == "Y", "yn_to_bool", False),
        Field("commission_paise", "expected_commission", paise_of_rupees("expected_commission"), "rupees_to_paise"),
        Field("commission_rate_applied_bps", "commission_rate_bps", F.col("commission_rate_bps").try_cast("long"), "int"),
        Field("expected_tcs_paise", "expected_tcs", paise_of_rupees("expected_tcs"), "rupees_to_paise"),
        Field("expected_tds_paise", "expected_tds", paise_of_rupees("expected_tds"), "rupees_to_paise"),
    )


def bank_fields() -> tuple[Field, ...]:
    return (
        Field("amount_paise", "credit", paise_of_rupees("credit"), "rupees_to_paise"),
        Field("credited_on", "value_date", F.to_date(ist_midnight_to_utc("value_date") + F.expr("INTERVAL '5:30' HOUR TO MINUTE")), "date"),
        Field("utr", "narration", extract_utr("narration")["utr"], "extract_utr", False),
    )


def sellers_fields() -> tuple[Field, ...]:
    return (
        Field("commission_bps_n", "commission_bps", F.col("commission_bps").try_cast("long"), "int"),
        Field("effective_from_d", "effective_from", F.col("effective_from").try_cast("date"), "date"),
        Field("effective_to_d", "effective_to", F.nullif("effective_to", F.lit("")).try_cast("date"), "date", False),
    )




def _whole(path: str) -> Column:
    """A whole number of a VARIANT; null for a fraction, as its text shows."""
    return F.try_variant_get("item", path, "string").try_cast("long")


def _text(path: str) -> Column:
    return F.try_variant_get("item", path, "string")


def payment_fields() -> tuple[Field, ...]:
    return (
        Field("payment_id", "$.id", _text("$.id"), "copy"), Field("order_id", "$.order_id", _text("$.order_id"), "copy"),
        Field("amount_paise", "$.amount", _whole("$.amount"), "int"), Field("method", "$.method", F.when(_text("$.method").isin("upi", "card", "netbanking", "wallet"), _text("$.method")), "enum"),
        Field("status", "$.status", _text("$.status"), "copy"), Field("captured_at_utc", "$.captured_at", epoch_to_utc(_whole("$.captured_at")), "epoch_to_utc"),
        Field("fee_paise", "$.fee", _whole("$.fee"), "int"), Field("tax_paise", "$.tax", _whole("$.tax"), "int"),
    )


def transfer_fields() -> tuple[Field, ...]:
    return (
        Field("transfer_id", "$.id", _text("$.id"), "copy"), Field("payment_id", "$.payment_id", _text("$.payment_id"), "copy"),
        Field("linked_account_id", "$.recipient", _text("$.recipient"), "copy"), Field("amount_paise", "$.amount", _whole("$.amount"), "int"),
        Field("on_hold", "$.on_hold", F.try_variant_get("item", "$.on_hold", "boolean"), "copy"),
        Field("on_hold_until_utc", "$.on_hold_until", epoch_to_utc(_whole("$.on_hold_until")), "epoch_to_utc", False),
        Field("settled_at_utc", "$.settled_at", epoch_to_utc(_whole("$.settled_at")), "epoch_to_utc", False),
    )


def refund_fields() -> tuple[Field, ...]:
    return (
        Field("refund_id", "$.id", _text("$.id"), "copy"), Field("payment_id", "$.payment_id", _text("$.payment_id"), "copy"),
        Field("amount_paise", "$.amount", _whole("$.amount"), "int"), Field("created_at_utc", "$.created_at", epoch_to_utc(_whole("$.created_at")), "epoch_to_utc"),
    )


def reversal_fields() -> tuple[Field, ...]:
    return (
        Field("reversal_id", "$.id", _text("$.id"), "copy"), Field("transfer_id", "$.transfer_id", _text("$.transfer_id"), "copy"),
        Field("amount_paise", "$.amount", _whole("$.amount"), "int"), Field("created_at_utc", "$.created_at", epoch_to_utc(_whole("$.created_at")), "epoch_to_utc"),
    )


def dispute_fields() -> tuple[Field, ...]:
    return (
        Field("dispute_id", "$.id", _text("$.id"), "copy"), Field("payment_id", "$.payment_id", _text("$.payment_id"), "copy"),
        Field("amount_paise", "$.amount", _whole("$.amount"), "int"), Field("status", "$.status", _text("$.status"), "copy"),
        Field("deducted_amount_paise", "$.deducted_amount", _whole("$.deducted_amount"), "int"),
    )


def settlement_fields() -> tuple[Field, ...]:
    return (
        Field("settlement_recon_id", "$.id", _text("$.id"), "copy"), Field("entity_key", "$.entity_id", _text("$.entity_id"), "copy", False),
        Field("entity_type", "$.entity_type", _text("$.entity_type"), "copy"), Field("settlement_id", "$.settlement_id", _text("$.settlement_id"), "copy"),
        Field("utr", "$.utr", _text("$.utr"), "copy"), Field("amount_paise", "$.amount", _whole("$.amount"), "int"), Field("fee_paise", "$.fee", _whole("$.fee"), "int"),
        Field("tax_paise", "$.tax", _whole("$.tax"), "int"), Field("debit_paise", "$.debit", _whole("$.debit"), "int"), Field("credit_paise", "$.credit", _whole("$.credit"), "int"),
        Field("settled_at_utc", "$.settled_at", epoch_to_utc(_whole("$.settled_at")), "epoch_to_utc"), Field("dispute_key", "$.dispute_id", _text("$.dispute_id"), "copy", False),
    )


PROCESSOR = {
    "payments": payment_fields, "transfers": transfer_fields, "refunds": refund_fields, "reversals": reversal_fields, "disputes": dispute_fields, "settlements": settlement_fields,
}


def normalised(raw: DataFrame, fields: tuple[Field, ...], what: str) -> DataFrame:
    """raw with the canonical columns, quarantine_reason and quarantine_detail (the first malformed source column).

    Each value is parsed once, in a projection of its own, and read from there by the detail and by its column.
    """
    made = [(f, f"_{f.name}") for f in fields]
    rows = raw.withColumns({name: f.value for f, name in made})
    detail = F.coalesce(*[F.when(F.col(name).isNull(), F.lit(f"malformed {what} row: {f.source}")) for f, name in made if f.required])
    rows = rows.withColumn("quarantine_detail", detail)
    rows = rows.withColumns({f.name: F.when(F.col("quarantine_detail").isNull(), F.col(name)) for f, name in made})
    return rows.withColumn("quarantine_reason", F.when(F.col("quarantine_detail").isNotNull(), F.lit(REASON))).drop(*[name for _, name in made])


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and quarantined ones."""
    return rows.where("quarantine_reason is null"), rows.where("quarantine_reason is not null")


def lineage(rows: DataFrame, fields: tuple[Field, ...], key: str) -> DataFrame:
    """key, step, field, before_text, after_text, rule_id of each normalisation up to a row's first malformed field."""
    steps = []
    for n, f in enumerate(fields):
        after = utc_text(f.value) if f.rule in ("ist_to_utc", "epoch_to_utc") else f.value.cast("string")
        before = F.col(f.source) if not f.source.startswith("$") else _text(f.source)
        steps.append(F.struct(F.lit(n + 1).alias("step"), F.lit(f.name).alias("field"), before.alias("before_text"), after.alias("after_text"), F.lit(f.rule).alias("rule_id"), (f.value.isNull() & F.lit(f.required)).alias("bad")))
    every = rows.select(key, F.array(*steps).alias("steps"))
    first_bad = F.array_position(F.transform("steps", lambda s: s["bad"]), True)
    reached = F.when(first_bad == 0, F.col("steps")).otherwise(F.slice("steps", F.lit(1), (first_bad - 1).cast("int")))
    return every.select(key, F.explode(reached).alias("s")).select(key, "s.step", "s.field", "s.before_text", "s.after_text", "s.rule_id")


def resolved_sellers(rows: DataFrame, sellers: DataFrame) -> DataFrame:
    """rows (seller_name) with seller_id and resolution: one seller of that name, none, or several."""
    names = sellers.groupBy(F.col("seller_name").alias("_name")).agg(F.array_sort(F.collect_set("seller_id")).alias("_ids"))
    met = rows.join(names, rows["seller_name"] == names["_name"], "left")
    n = F.coalesce(F.size("_ids"), F.lit(0))
    found = F.when(n == 1, F.get("_ids", F.lit(0))).otherwise(F.col("seller_name"))
    how = F.when(n == 1, "seller_name_resolved").when(n > 1, "seller_name_ambiguous").otherwise("seller_name_not_found")
    return met.withColumns({"seller_id": found, "resolution": how}).drop("_name", "_ids")


def counts(rows: DataFrame, source: str) -> DataFrame:
    """source, total, normalised, quarantined."""
    bad = F.col("quarantine_reason").isNotNull()
    return rows.agg(F.count("*").alias("total"), F.count_if(~bad).alias("normalised"), F.count_if(bad).alias("quarantined")).select(F.lit(source).alias("source"), "total", "normalised", "quarantined")
