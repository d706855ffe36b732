"""Hard negatives against a plain loop."""

import numpy as np
from pyspark.sql import functions as F

from assure.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, place int, own string"


def plain(rows, label_of, k=5):
    kept = [(i, np.floor(256 * np.array(e, np.float64)).astype(np.int64), label_of(i, y)) for i, e, y in rows if i is not None and e is not None and y is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, e, y in kept:
        if i % 100:
            continue
        others = sorted(((int(e @ f), j, z) for j, f, z in kept if j != i and len(f) == len(e)), key=lambda x: (-x[0], x[1]))
        for p, j, _ in [x for x in others if x[2] == y][:k]:
            found = [(n, m) for n, m, z in others if z != y and 80 * p <= 100 * n <= 100 * p][:k]
            out += [(i, j, r, m, p, n) for r, (n, m) in enumerate(found, 1)]
    return sorted(out)


def test_negatives_are_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 6)).astype(np.float32) + 0.6
    v[300:360] = v[300]  # ties
    rows = [(i, [float(x) for x in v[i]], int(rng.integers(0, 10)) if i % 3 else 4) for i in range(600)]
    rows += [(700, None, 1), (800, [1.0] * 6, None), (900, [1.0, None], 1), (1000, [float("nan")] * 6, 1), (1100, [1.0, 2.0], 1), (1101, [1.0, 2.0], 1), (None, [1.0] * 6, 1)]
    rows += [rows[100], rows[200], rows[205]] + [(1200, [0.0] * 6, 2), (1201, [], 3), (1300, [], 3)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    how = negatives.Mining(block_rows=50, anchor_rows=3)
    got = negatives.hard_negatives(df, negatives.relabelled(F.col("vec_id"), F.col("label")), how)
    want = plain(rows, lambda i, y: (y + 1) % 10 if i % 7 == 0 else y)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50
    assert sorted(map(tuple, negatives.hard_negatives(df).collect())) == plain(rows, lambda i, y: y)
    assert negatives.hard_negatives(df.limit(0)).count() == 0


def test_scores_that_are_not_exact_are_refused():
    import pytest

    from assure.llm.vectors import inner

    with pytest.raises(OverflowError):
        inner(np.full((1, 4), 2.0**26), np.full((1, 4), 2.0**26))
