"""Dates and instants; the session runs in UTC, sources state IST or epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import col

UTC_TEXT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def ist_to_utc(text) -> Column:
    """yyyy-MM-dd HH:mm:ss in IST as a UTC instant; null if malformed."""
    return F.to_utc_timestamp(F.try_to_timestamp(col(text), F.lit("yyyy-MM-dd HH:mm:ss")), "Asia/Kolkata")


def ist_midnight_to_utc(text) -> Column:
    """The UTC instant at which a day begins in IST."""
    return F.to_utc_timestamp(F.try_to_timestamp(col(text), F.lit("yyyy-MM-dd")), "Asia/Kolkata")


def epoch_to_utc(seconds) -> Column:
    return F.timestamp_seconds(col(seconds))


def utc_text(instant) -> Column:
    return F.date_format(col(instant), UTC_TEXT)


def ist_text(instant) -> Column:
    """An instant as the ledger writes it, in IST."""
    return F.date_format(F.from_utc_timestamp(col(instant), "Asia/Kolkata"), "yyyy-MM-dd HH:mm:ss")


def period(instant) -> Column:
    return F.date_format(col(instant), "yyyy-MM")


def within_days(a, b, days: int) -> Column:
    return F.abs(F.datediff(col(a).cast("date"), col(b).cast("date"))) <= days


def age_days(as_of, day) -> Column:
    return F.datediff(col(as_of).cast("date"), col(day).cast("date"))
