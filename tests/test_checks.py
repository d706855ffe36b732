"""Each check fires where it should and nowhere else, with the amount worked by hand."""

import datetime as dt

import pytest

from assure.operators import checks

AS_OF = "2026-08-26"
BASE = dict(
    k=1, gross=1_000_000, applied_bps=1500, card_bps=1500, tcs=5_000, tds=1_000, placed=dt.date(2026, 7, 1), n_payments=1, fee=20_000, tax=3_600, fee_gst=3_600, n_refunds=0, refunds=0, disputes=0,
    n_orphaned=0, orphaned=0, n_reversals=0, reversals=0, n_recons=1, credit=830_000, debit=0, completeness="full",
)
KINDS = ", ".join(f"{c} {'date' if c == 'placed' else 'string' if c == 'completeness' else 'int' if c.endswith('_bps') else 'long'}" for c in BASE)

CASES = [
    ({}, {}),
    ({"applied_bps": 1600}, {"D01": 10_000}),
    ({"credit": 829_500}, {"D02": 500}),
    ({"credit": 828_000}, {}),
    ({"n_refunds": 1, "refunds": 40_000, "disputes": 10_000, "debit": 50_000, "tcs": 4_800}, {}),
    ({"n_refunds": 1, "refunds": 50_000, "debit": 0, "tcs": 4_750, "credit": 830_000}, {"D03": 50_000}),
    ({"n_refunds": 1, "refunds": 50_000, "debit": 50_000, "tcs": 5_000}, {"D04": 250}),
    ({"tds": 0}, {"D05": 1_000}),
    ({"completeness": "missing_settlement", "n_recons": 0, "credit": 0, "n_orphaned": 1, "orphaned": 50_000}, {"D06": 50_000}),
    ({"completeness": "missing_settlement", "n_recons": 0, "credit": 0, "n_orphaned": 1, "orphaned": 50_000, "placed": dt.date(2026, 8, 18)}, {}),
    ({"n_reversals": 1, "reversals": 98_000}, {"D07": 98_000}),
    ({"tax": 3_000}, {"D08": 600}),
    ({"completeness": "intent_only", "n_payments": 0, "n_recons": 0, "fee": 0, "tax": 0, "fee_gst": 0, "credit": 0}, {}),
]


@pytest.mark.parametrize("change, expected", CASES)
def test_checks(spark, change, expected):
    rows = checks.amounts(spark.createDataFrame([tuple((BASE | change).values())], KINDS), AS_OF)
    specs = checks.checks(AS_OF)
    assert {r["defect"]: r["amount"] for r in checks.findings(rows, specs).collect()} == expected
    last = {}
    for r in sorted(checks.trace(rows, specs).collect(), key=lambda r: r["step_no"]):
        last[r["defect"]] = r["output"]
    assert last == expected


def test_skips_are_tallied(spark):
    rows = checks.amounts(spark.createDataFrame([tuple((BASE | {"completeness": "intent_only", "card_bps": None}).values())], KINDS), AS_OF)
    got = {(r["defect"], r["reason"]) for r in checks.skip_tally(rows, checks.checks(AS_OF)).collect()}
    assert ("D01", "applies_to() declined") in got and ("D02", "completeness=intent_only not in requires") in got
