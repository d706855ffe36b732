"""Narrations, keys and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import col

# The reference numbers that bank narrations carry, in order of trust (basis points).
UTR_PATTERNS = (
    ("utr_labelled", r"\bUTR[:\s-]*([A-Z0-9]{12,22})\b", 10_000),
    ("neft_ref", r"\bNEFT[/\s-]*([A-Z]{4}[A-Z0-9]{8,18})\b", 9_500),
    ("rtgs_ref", r"\bRTGS[/\s-]*([A-Z0-9]{16,22})\b", 9_500),
    ("imps_ref", r"\bIMPS[/\s-]*(\d{12})\b", 9_000),
    ("bare_token", r"\b([A-Z]{4}[A-Z0-9]{12,18})\b", 6_000),
)


def extract_utr(narration) -> Column:
    """struct(utr, confidence_bps, pattern). The first pattern that hits decides, even if its hits disagree."""
    out = F.struct(F.lit(None).cast("string").alias("utr"), F.lit(0).alias("confidence_bps"), F.lit("no_match").alias("pattern"))
    torn = F.struct(F.lit(None).cast("string").alias("utr"), F.lit(0).alias("confidence_bps"), F.lit("ambiguous_narration").alias("pattern"))
    for name, pattern, bps in reversed(UTR_PATTERNS):
        hits = F.array_distinct(F.regexp_extract_all(col(narration), F.lit(pattern), F.lit(1)))
        one = F.struct(F.get(hits, F.lit(0)).alias("utr"), F.lit(bps).alias("confidence_bps"), F.lit(name).alias("pattern"))
        out = F.when(F.size(hits) == 1, one).when(F.size(hits) > 1, torn).otherwise(out)
    return out


def canonical_id(raw_id, prefix: str) -> Column:
    """The raw id's number under another prefix."""
    return F.concat(F.lit(prefix + "_"), F.element_at(F.split(col(raw_id), "_"), -1))


def record_key(prefix: str, number) -> Column:
    """prefix and number, padded to five digits; larger numbers keep all of theirs."""
    n = col(number).cast("string")
    return F.concat(F.lit(prefix + "_"), F.when(F.length(n) < 5, F.lpad(n, 5, "0")).otherwise(n))


def is_record_key(key) -> Column:
    return col(key).rlike(r"^[a-z]+_\d{5,}$")


def digest(*columns) -> Column:
    """sha256 of the columns as JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
