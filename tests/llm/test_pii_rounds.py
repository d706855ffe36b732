"""The bootstrap of op1 goes on until it settles."""

import pytest

from assure.llm import pii


def graph(spark, hops):
    """Pattern h is confident (9 of 11 known) only when the two instances that pattern h - 1 leads to are known."""
    rows = [("p0", f"s{k}", "phone", 2) for k in range(2)]
    for h in range(hops):
        rows += [(f"p{h}", f"s{h}.{k}", "phone", 2) for k in range(7)]
        rows += [(p, f"i{h}.{k}", "phone", 0) for p in (f"p{h}", f"p{h + 1}") for k in range(2)]
    return spark.createDataFrame(rows, "pattern string, instance string, kind string, seed int")


def test_instances_many_hops_away_are_accepted(spark):
    got = {tuple(r) for r in pii.bootstrap(graph(spark, 5)).collect()}
    assert got == {(f"i{h}.{k}", "phone") for h in range(5) for k in range(2)}


def test_a_graph_that_does_not_settle_in_time_is_an_error(spark):
    with pytest.raises(RuntimeError):
        pii.bootstrap(graph(spark, 5), rounds=3)
