"""Money is whole paise in BIGINT, rates are whole basis points; nothing here makes a DOUBLE."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def div(a, by) -> Column:
    """Integral division in BIGINT; truncates towards zero."""
    return F.call_function("div", col(a).cast("long"), col(by).cast("long"))


def apply_bps(amount, bps) -> Column:
    """amount * bps / 10000, rounded half up on the magnitude; the sign is put back afterwards."""
    a = col(amount).cast("long")
    share = div(F.abs(a) * col(bps).cast("long") + F.lit(5000).cast("long"), 10000)
    return F.when(a < 0, -share).otherwise(share)


def sum_paise(amount) -> Column:
    """Exact sum, 0 over nothing."""
    return F.coalesce(F.sum(col(amount)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Tolerance:
    """A band: the larger of a fixed amount and a share of the expected one; and a number of days."""

    name: str = "default_v1"
    abs_paise: int = 100
    rel_bps: int = 10
    days: int = 2

    def band(self, expected) -> Column:
        return F.greatest(F.lit(self.abs_paise).cast("long"), apply_bps(F.abs(col(expected)), self.rel_bps))

    def within(self, expected, actual) -> Column:
        """Inclusive; the band is the expected amount's."""
        return F.abs(col(expected) - col(actual)) <= self.band(expected)


def paise_of_rupees(text, strict_sign: bool = False) -> Column:
    """Paise of a text like 1,234.50; null if it is no amount.

    Decimals past the second are cut off. The fraction is added to the signed whole part, so -5.50 gives -450;
    strict_sign gives -550 instead.
    """
    x = col(text)
    whole_text = F.replace(F.split_part(x, F.lit("."), F.lit(1)), F.lit(","), F.lit(""))
    part = F.split_part(x, F.lit("."), F.lit(2))
    whole = F.when(whole_text.rlike(r"^[+-]?[0-9]+$"), whole_text.try_cast("long"))
    cents = F.when(part == "", F.lit(0).cast("long")).otherwise(
        F.when(part.rlike(r"^[0-9]+$"), F.rpad(F.substring(part, 1, 2), 2, "0").try_cast("long"))
    )
    if strict_sign:
        cents = F.when(whole_text.startswith("-"), -cents).otherwise(cents)
    return whole * 100 + cents


def format_inr(paise) -> Column:
    """Rupees with Indian grouping: three digits, then twos."""
    p = col(paise).cast("long")
    rupees, rest = div(F.abs(p), 100).cast("string"), F.lpad((F.abs(p) % 100).cast("string"), 2, "0")
    grouped = F.regexp_replace(rupees, r"(?<=\d)(?=(\d\d)+\d$)", ",")
    return F.concat(F.when(p < 0, F.lit("-")).otherwise(F.lit("")), F.lit("₹"), grouped, F.lit("."), rest)


def rupee_text(paise) -> Column:
    """Rupees as the source files write them: no grouping, two decimals."""
    p = col(paise).cast("long")
    return F.concat(F.when(p < 0, F.lit("-")).otherwise(F.lit("")), div(F.abs(p), 100).cast("string"), F.lit("."), F.lpad((F.abs(p) % 100).cast("string"), 2, "0"))


def severity(amount) -> Column:
    a = col(amount)
    return F.when(a >= 100_000, "high").when(a >= 10_000, "medium").otherwise("low")


def ratio(part, whole) -> Column:
    """part / whole as DOUBLE, null (not measured) over 0: for scores and reports only."""
    return F.try_divide(col(part).cast("double"), col(whole).cast("double"))
