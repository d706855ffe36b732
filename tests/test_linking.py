"""The passes: scenarios by hand, and invariants on generated pools."""

import datetime as dt
import itertools
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assure.operators import linking, subsets
from assure.operators.components import components

DAY = dt.date(2026, 7, 1)


def frames(spark, pending, banks):
    p = spark.createDataFrame([(i, t, s, DAY + dt.timedelta(d)) for i, t, s, d in pending], "pending_id long, target_paise long, settlement_id long, settled date")
    b = spark.createDataFrame([(i, a, DAY + dt.timedelta(d)) for i, a, d in banks], "bank_id long, amount long, credited date")
    return p, b


def linked(spark, pending, banks):
    got = linking.link(*frames(spark, pending, banks))
    groups = {(r["pending_id"], r["pass"], r["bank_id"]) for r in got.groups.collect()}
    return groups, {tuple(r) for r in got.ambiguous.collect()}, {r["bank_id"] for r in got.unmatched_banks.collect()}


@pytest.fixture(autouse=True)
def shared(spark):
    from assure.operators.components import checkpoint_dir

    checkpoint_dir(spark)


def test_exact_amount_and_date(spark):
    assert linked(spark, [(1, 98_000, 1, 0)], [(7, 98_000, 0)])[0] == {(1, "P1", 7)}


def test_a_tie_is_reported_not_guessed(spark):
    groups, ambiguous, loose = linked(spark, [(1, 50_000, 1, 0), (2, 50_000, 2, 0)], [(7, 50_000, 0)])
    assert groups == {(1, "P0", None), (2, "P0", None)} and loose == {7} and len(ambiguous) == 2


def test_one_credit_for_a_whole_settlement(spark):
    assert linked(spark, [(1, 30_000, 5, 0), (2, 70_000, 5, 0)], [(7, 100_000, 3)])[0] == {(1, "P2", 7), (2, "P2", 7)}


def test_subsets_that_tie(spark):
    groups, ambiguous, loose = linked(spark, [(1, 100_000, 5, 0)], [(1, 40_000, 9), (2, 60_000, 9), (3, 25_000, 9), (4, 75_000, 9)])
    assert groups == {(1, "P0", None)} and loose == {1, 2, 3, 4} and {a[1] for a in ambiguous} == {"P2"}


def test_band(spark):
    assert linked(spark, [(1, 98_000, 1, 0)], [(7, 97_910, 1)])[0] == {(1, "P3", 7)}
    assert linked(spark, [(1, 98_000, 1, 0)], [(7, 97_500, 1)])[0] == {(1, "P0", None)}


def subsets_of(target, pool):
    """Brute force: status, and the subsets of pool (amount, id)."""
    if len(pool) > 40:
        return "too_large", []
    if pool and sum(a for a, _ in pool) == target:
        return "unique", [tuple(i for _, i in pool)]
    hits = [tuple(i for _, i in c) for n in range(2, 6) for c in itertools.combinations(pool, n) if sum(a for a, _ in c) == target]
    return "unique" if len(hits) == 1 else "ambiguous", hits


def test_subset_matches(spark):
    rng = random.Random(8)
    pools = {0: [(rng.randint(1, 60), 100 + i) for i in range(12)], 1: [(300, 1), (700, 2), (50, 3)], 2: [(500, 11), (500, 12), (200, 13), (800, 14)], 3: [(1, 1000 + i) for i in range(41)], 4: [(5, 5000)], 5: [(-5, 20), (5, 21), (7, 22)]}
    targets = [(0, 9000 + t, t) for t in range(1, 250)] + [(1, 1, 1000), (1, 2, 1050), (2, 3, 1000), (3, 4, 2), (4, 5, 5), (4, 6, 10), (5, 7, 0), (5, 8, 7), (6, 9, 1)]
    credits = spark.createDataFrame([(p, i, a) for p, c in pools.items() for a, i in c], "pool int, bank_id long, amount long")
    got = {tuple(r) for r in subsets.subset_matches(credits, spark.createDataFrame(targets, "pool int, target_id long, target long"), "pool").collect()}
    want = set()
    for p, t, target in targets:
        if p == 3:
            want.add((t, "too_large", None))
        else:
            status, hits = subsets_of(target, pools.get(p, []))
            want |= {(t, status, i) for h in hits for i in h}
    assert got == want and {s for _, s, _ in got} == {"unique", "ambiguous", "too_large"}


def test_a_pool_reaches_all_its_sums(spark):
    rows = spark.createDataFrame([(0, 40, list(range(40)), [3**20 + i for i in range(40)])], "p int, n int, ids array<long>, amounts array<long>")
    n = sum(math.comb(40, k) for k in range(2, 6))
    assert tuple(subsets.reachable(rows, "p").select(F.count("*"), F.count_distinct("mask")).first()) == (n, n)


@pytest.mark.parametrize("seed", range(4))
def test_equal_amounts_in_turn(spark, seed):
    rng = random.Random(seed)
    banks = [(i, rng.choice([100, 200, 300, 500, 900]) if seed else rng.randint(50, 90), 0) for i in range(rng.randint(1, 9))]
    pending = [(i, rng.choice([100, 200, 300, 400, 500, 600, 800, 1000, 1500, sum(a for _, a, _ in banks)]) if seed else rng.randint(50, 300), 10 + i, 5) for i in range(30)]
    p, b = frames(spark, pending, banks)
    assert {tuple(r) for r in linking.grouped_sums(linking.settlements(p), b).collect()} == one_by_one(pending, banks)


def test_bands_are_all_pairs(spark):
    rng = random.Random(5)
    base = [rng.choice([5, 99, 1000, 99_999, 100_050, 131_072, 1_048_576, 99_999_999]) for _ in range(60)]
    near = lambda: rng.choice((-1, 1)) * rng.randint(0, 210)
    pending = [(i, (t + near()) * rng.choice((1, 1, -1)), i, rng.randint(0, 5)) for i, t in enumerate(base)]
    banks = [(i, (t + near() * (1 + t // 200_000)) * rng.choice((1, 1, -1)), rng.randint(0, 5)) for i, t in enumerate(base * 3)]
    got = sorted(map(tuple, linking.band_pairs(*frames(spark, pending, banks)).collect()))

    def band(t):
        return max(100, (abs(t) * 10 + 5000) // 10_000)

    want = sorted((i, j) for i, t, _, d in pending for j, a, e in banks if abs(t - a) <= band(t) and abs(d - e) <= 2)
    assert got == want and len(want) > 100


def test_many_credits_of_one_day(spark):
    pending = spark.range(100_000).selectExpr("id AS pending_id", "id * 1000 AS target_paise", "id AS settlement_id", "DATE '2026-07-01' AS settled")
    banks = spark.range(100_000).selectExpr("id AS bank_id", "id * 1000 + 40 AS amount", "DATE '2026-07-01' AS credited")
    got = linking.band_pairs(pending, banks).selectExpr("COUNT(*) AS n", "COUNT_IF(pending_id = bank_id) AS own").first()
    wide = sum((min(99_999, (1000 * t - 40 + w) // 1000) - max(0, -((w - 1000 * t + 40) // 1000)) + 1) for t in range(100_000) for w in [max(100, (t * 10_000 + 5000) // 10_000)])
    assert got["own"] == 100_000 and got["n"] == wide


def test_the_closed_form_is_the_sequential_routine(spark):
    rng = random.Random(3)
    banks = [(i, rng.randint(1, 30) * 1000 + 1_000_000, 0) for i in range(130)]
    pending = [(i, rng.randint(1, 40) * 1000 + 1_000_000, i, 5) for i in range(25)]
    p, b = frames(spark, pending, banks)
    got = {tuple(r) for r in linking.grouped_sums(linking.settlements(p), b).collect()}
    free, want = dict((i, a) for i, a, _ in banks), set()
    for i, target, s, _ in pending:
        hits = [k for k, a in free.items() if a == target]
        want |= {(s, "unique" if len(hits) == 1 else "ambiguous", k) for k in hits}
        if len(hits) == 1:
            del free[hits[0]]
    assert got == want


def one_by_one(pending, banks):
    """The sequential routine over any pool."""
    free, want = {i: a for i, a, _ in banks}, set()
    for i, target, s, _ in sorted(pending):
        single = [k for k, a in free.items() if a == target]
        status, hits = ("unique" if len(single) == 1 else "ambiguous", [(k,) for k in single]) if single else subsets_of(target, [(a, k) for k, a in free.items()])
        want |= {(s, status, k) for hit in hits for k in hit}
        if status == "unique":
            for k in hits[0]:
                del free[k]
    return want


@pytest.mark.parametrize(("credits", "claims"), [(100, 70), (100, 60), (100, 59), (60, 20), (45, 4), (40, 0)])
def test_subsets_are_tried_once_claims_leave_few_credits(spark, credits, claims):
    # cubes keep most sums of two unique
    banks = [(i, 1_000_000 + 7 * i * i * i, 0) for i in range(credits)]
    pair = lambda a, b: banks[a][1] + banks[b][1]
    pending = [(0, pair(credits - 1, credits - 2), 900, 5)]  # too early unless the pool is small
    pending += [(1 + i, banks[i][1], 100 + i, 5) for i in range(claims)]
    pending += [(200, pair(credits - 3, credits - 5), 800, 5), (201, banks[credits - 7][1], 801, 5), (202, pair(credits - 9, credits - 12), 802, 5), (203, banks[0][1], 803, 5)]
    p, b = frames(spark, pending, banks)
    got = {tuple(r) for r in linking.grouped_sums(linking.settlements(p), b).collect()}
    want = one_by_one(pending, banks)
    assert got == want and any(s == 802 for s, _, _ in want)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(0, 3), st.integers(0, 2)), min_size=1, max_size=8), st.lists(st.tuples(st.integers(1, 9), st.integers(0, 3)), min_size=1, max_size=8))
def test_nothing_is_claimed_twice_or_lost(spark, chains, credits):
    pending = [(i, a * 10_000, s, d) for i, (a, d, s) in enumerate(chains)]
    banks = [(i, a * 10_000, d) for i, (a, d) in enumerate(credits)]
    groups, _, loose = linked(spark, pending, banks)
    assert {g[0] for g in groups} == set(range(len(pending)))
    claimed = {g[2] for g in groups if g[2] is not None}
    assert claimed.isdisjoint(loose) and claimed | loose == set(range(len(banks)))
    amounts = {i: a for i, a, _ in banks}
    for p, name, bank in groups:
        if name == "P1":
            assert amounts[bank] == pending[p][1]


def test_components_follow_chains(spark):
    edges = [(i, f"v{i}") for i in range(30)] + [(i + 1, f"v{i}") for i in range(30)] + [(100, None), (101, None)]
    got = dict(components(spark.createDataFrame(edges, "node long, value string")).collect())
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 101}
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame(edges, "node long, value string"), rounds=1)


def test_components_without_shared_nodes_need_no_round(spark):
    rows = [(i, f"v{i}") for i in range(5)] + [(100 + i, f"v{i}") for i in range(5)] + [(3, "v3"), (50, None), (4, None)]
    got = dict(components(spark.createDataFrame(rows, "node long, value string"), rounds=0).collect())
    assert got == {**{i: i for i in range(5)}, **{100 + i: i for i in range(5)}, 50: 50}


def test_components_equal_a_plain_search(spark):
    rows = [(n, None if (n * 7 + v) % 5 == 0 else f"v{(n * n + 13 * v) % 60}") for n in range(90) for v in range(1 + n % 3)]
    of = {n: n for n, _ in rows}
    for _ in rows:
        for a, x in rows:
            for b, y in rows:
                if x is not None and x == y and of[a] != of[b]:
                    of[a] = of[b] = min(of[a], of[b])
        if all(of[a] == of[b] for a, x in rows for b, y in rows if x is not None and x == y):
            break
    got = components(spark.createDataFrame(rows, "node long, value string")).collect()
    assert len(got) == len(of) and dict(got) == of


def test_contested_key(spark):
    df = spark.createDataFrame([([["b2", "o1"], ["b1", "o1"]],), ([["b9", "o1"]],)], "c array<array<string>>")
    assert [r[0] for r in df.select(linking.contested(F.col("c"))).collect()] == ["b1", "b9"]
