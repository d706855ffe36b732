"""The near-dedup stage of the pipeline against brute force over all pairs."""

import random

import xxhash

import corpus_pipeline
from test_llm import documents, words


def near_copies(seed=7, docs=40):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(docs):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 160))]
        rows.append((10 * i, " ".join(base), "en", "s"))
        for k in range(1, rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((10 * i + k, " ".join(copy), "en", "s"))
    return rows


def fingerprint(text):
    w = words(text.lower())
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 5]).encode(), 42) for k in range(max(1, len(w) - 4))] if w else [0]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    """The rows that stay."""
    prints = [fingerprint(r[1] or "") for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        best.setdefault(find(i), []).append((r[0] is None, r[0] or 0, i))
    return {rows[min(x)[2]][:2] for x in best.values()}


def kept(spark, rows):
    return {(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, documents(spark, rows), "").collect()}


def test_the_stage_keeps_one_of_each_group(spark):
    rows = near_copies()
    rows += [(5000 + i, r[1] + " end", *r[2:]) for i, r in enumerate(rows[::3])]
    want = brute(rows)
    assert 40 <= len(want) < len(rows)
    assert kept(spark, rows) == want
