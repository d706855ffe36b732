"""Discovery of secrets and identifiers: what contexts confirm, and what they leave alone."""

import random
from collections import defaultdict
from math import exp, floor, log1p

from assure.llm import pii


def hexes(rng, n=40):
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


def docs(spark):
    rng = random.Random(2)
    rows = [(i, f'some prose here, then token = "{hexes(rng)}" and more of it {i}') for i in range(8)]
    rows += [(20, 'another format: token = "Qz81-kkLm-3309-ppWx7" at the end'), (21, f"a commit {hexes(rng)} alone"), (22, "token = short"), (23, None), (None, f'token = "{hexes(rng)}"')]
    rows += [(24, "x" * 50_000 + "1" * 5 + ' token = "' + hexes(rng) + '"'), (25, f'token = "{hexes(rng)}" token = "{hexes(rng)}"')]
    return rows, spark.createDataFrame([(i, t, 3, "k") for i, t in rows], "doc_id long, text string, seed int, kind string")


def test_secrets_by_context(spark):
    rows, df = docs(spark)
    got = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = []
        at = (t or "").find('token = "')
        while at >= 0:
            end = t.index('"', at + 9)
            want.append(f"secret:{at + 9}:{end}")
            at = t.find('token = "', end)
        base = [f"{k}:{s}:{e}" for s, e, k in pii.base_spans(t or "")]  # digits in a key may pass for a card
        assert sorted(got[i]["spans"].split(",") if got[i]["spans"] else []) == sorted(want + base) and got[i]["n_found"] == len(want), i


def test_scores_are_brute_force(spark):
    rng = random.Random(5)
    pairs = set()
    for _ in range(400):
        instance = rng.randrange(60)
        pairs.add((f"p{rng.randrange(12)}", f"i{instance}", rng.choice(["card", "secret"]) if instance % 9 == 0 else ["card", "secret"][instance % 2], (0, 0, 1, 2)[instance % 4]))
    known = {(i, k) for _, i, k, s in pairs if s}
    sizes = defaultdict(set)
    for p, i, _, _ in pairs:
        sizes[p].add(i)
    while True:
        good = defaultdict(set)
        for p, i, k, _ in pairs:
            if (i, k) in known:
                good[p, k].add(i)
        sure = {x: len(g) / (len(sizes[x[0]]) + 1) for x, g in good.items() if len(g) >= pii.SUPPORT and len(g) / (len(sizes[x[0]]) + 1) >= 0.6}
        weight = defaultdict(int)
        for p, i, k, s in pairs:
            if s < 2 and (p, k) in sure:
                weight[i, k] += floor(-1e6 * log1p(-sure[p, k]) + 0.5)
        accepted = {x for x, w in weight.items() if 1 - exp(-w / 1e6) >= pii.SCORE}
        if accepted <= known:
            break
        known |= accepted
    old, pii.CONFIDENCE = pii.CONFIDENCE, 0.6
    try:
        got = pii.bootstrap(spark.createDataFrame(sorted(pairs), "pattern string, instance string, kind string, seed int")).collect()
    finally:
        pii.CONFIDENCE = old
    assert {r["instance"] for r in got} == {i for i, _ in accepted}
