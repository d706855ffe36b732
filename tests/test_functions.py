"""Hand numbers of money, dates and text."""

from pyspark.sql import functions as F

from assure.functions import dates, money, text


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).head()["x"]


def test_bps_rounds_half_up_on_the_magnitude(spark):
    for amount, bps, expected in ((1000, 15, 2), (-500, 10, -1), (10_000, 10, 10), (8_000, 50, 40), (10_000, 1800, 1800), (0, 50, 0)):
        assert one(spark, money.apply_bps(F.lit(amount), F.lit(bps))) == expected


def test_inr_groups_the_indian_way(spark):
    shown = {120000: "₹1,200.00", 3000: "₹30.00", 418: "₹4.18", 12000000: "₹1,20,000.00", -500: "-₹5.00", 0: "₹0.00"}
    for paise, expected in shown.items():
        assert one(spark, money.format_inr(F.lit(paise))) == expected


def test_band_is_inclusive_and_of_the_expected_amount(spark):
    t = money.Tolerance()
    assert [one(spark, t.band(F.lit(x))) for x in (1000, 500_000)] == [100, 500]
    assert one(spark, t.within(F.lit(500_000), F.lit(499_500))) is True
    assert one(spark, t.within(F.lit(500_000), F.lit(499_499))) is False


def test_rupee_texts(spark):
    for given, expected in (("1,234.50", 123450), ("-5.50", -450), ("-0.50", 50), ("7", 700), ("1.239", 123), ("", None), ("abc", None), ("1.x", None)):
        assert one(spark, money.paise_of_rupees(F.lit(given))) == expected
    assert one(spark, money.paise_of_rupees(F.lit("-5.50"), strict_sign=True)) == -550


def test_ist_is_five_and_a_half_hours_ahead(spark):
    assert one(spark, dates.utc_text(dates.ist_to_utc(F.lit("2026-07-01 01:30:00")))) == "2026-06-30T20:00:00Z"
    assert one(spark, dates.ist_to_utc(F.lit("2026-13-01 00:00:00"))) is None
    assert one(spark, dates.utc_text(dates.epoch_to_utc(F.lit(0)))) == "1970-01-01T00:00:00Z"


def test_narrations(spark):
    cases = {
        "UTR:ABCDEFGHIJKLMNO PLATFORM SETTLEMENT": ("ABCDEFGHIJKLMNO", 10_000, "utr_labelled"),
        "CREDIT ABCD1234567890AB AND WXYZ1234567890AB": (None, 0, "ambiguous_narration"),
        "UTR:ABCDEFGHIJKLMNO UTR:ABCDEFGHIJKLMNO": ("ABCDEFGHIJKLMNO", 10_000, "utr_labelled"),
        "hello": (None, 0, "no_match"),
    }
    for given, expected in cases.items():
        assert tuple(one(spark, text.extract_utr(F.lit(given)))) == expected


def test_keys_keep_long_numbers(spark):
    assert one(spark, text.record_key("exc", F.lit(7))) == "exc_00007"
    assert one(spark, text.record_key("exc", F.lit(1234567))) == "exc_1234567"
    assert one(spark, text.canonical_id(F.lit("raw_intent_00012"), "ord")) == "ord_00012"
