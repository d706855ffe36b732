"""Vector codes against plain Lloyd, and the trees against plain assignment."""

import hashlib

import numpy as np

from assure.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, dim int, code string"


def plain(vectors, how):
    """Codes, errors and codebooks of integer rows in order of vec_id."""
    k = how.parts
    parts = vectors.reshape(len(vectors), k, -1).transpose(1, 0, 2)
    books = parts[:, : how.entries].copy()

    def nearest():
        return ((parts[:, :, None] - books[:, None]) ** 2).sum(3)

    for _ in range(how.rounds):
        best = nearest().argmin(2)
        for p in range(k):
            for e in range(books.shape[1]):
                own = parts[p][best[p] == e]
                if len(own):
                    books[p, e] = own.sum(0) // len(own)
    square = nearest()
    return square.argmin(2).T, square.min(2).sum(0), books


def test_codes_are_plain_lloyd(spark):
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(700, 16)) * 0.3 + rng.integers(0, 3, (700, 1))).astype(np.float32)
    v[50:90] = v[50]
    v[3] = v[5]
    rows = [(i, [float(x) for x in v[i]], int(i % 3) if i % 11 else None) for i in range(700)]
    odd = [(900, None, 1), (901, [1.0, None], 1), (902, [float("inf")] * 16, 1), (903, [0.5, 0.25, -1.0], 2), (904, [], None), (905, [0.5, 0.25, -2.0], 2)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], SCHEMA).repartition(3)
    how = codes.Coding(block_rows=100, leaf=4)
    got = {r["vec_id"]: r for r in codes.vector_codes(df, how).collect()}
    whole = np.floor(4096 * v.astype(np.float64)).astype(np.int64)
    want, errors, books = plain(whole, how)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    assert len(got) == 703
    sums = {}
    for i, _, y in rows:
        sums[y] = sums.get(y, 0) + int(errors[i])
    small, small_errors, small_books = plain(np.floor(4096 * np.array([[0.5, 0.25, -1.0, 0, 0, 0, 0, 0], [0.5, 0.25, -2.0, 0, 0, 0, 0, 0]])).astype(np.int64), how)
    sums[2] += int(small_errors.sum())
    for i, _, y in rows:
        r = got[i]
        assert (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) == ("".join(f"{x:02x}" for x in want[i]), errors[i], sums[y], digest)
    assert got[903]["code"] == "".join(f"{x:02x}" for x in small[0]) and got[905]["code"] == "".join(f"{x:02x}" for x in small[1])
    assert got[904]["error"] == 0 and got[904]["code"] == "00" * 8
    assert codes.vector_codes(df.limit(0)).count() == 0


def test_repeated_rows_and_few_rows(spark):
    rows = [(1, [1.0] * 8, 1), (1, [1.0] * 8, 1), (2, [2.0] * 8, None), (None, [3.0] * 8, None)]
    got = codes.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r["vec_id"] or 0, r["code"], r["error"]) for r in got) == [(0, "03" * 8, 0), (1, "00" * 8, 0), (1, "00" * 8, 0), (2, "02" * 8, 0)]


def test_restored_vectors_have_the_errors(spark, sf):
    docs = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows, books = codes.compressed(docs)
    whole = {r["vec_id"]: np.floor(4096 * np.array(r["embedding"], np.float64)).astype(np.int64) for r in docs.collect()}
    for r in codes.restored(rows, books).collect():
        assert ((whole[r["vec_id"]] - np.array(r["v"])) ** 2).sum() == r["error"]


def test_trees_assign_as_plain_search():
    rng = np.random.default_rng(6)
    saved = 0
    for case in range(40):
        n, width, m = int(rng.integers(1, 400)), int(rng.integers(1, 5)), int(rng.integers(1, 12))
        parts = rng.integers(-6, 7, (3, n, width)).astype(np.int64) * (1 if case % 2 else 50)
        books = rng.integers(-6, 7, (3, m, width)).astype(np.int64) * (1 if case % 2 else 50)
        tree = codes.Forest.build(parts.copy(), 4)
        best = ((parts[:, :, None] - books[:, None]) ** 2).sum(3)
        got, errors = tree.assigned(books)
        assert (got == best.argmin(2).T).all() and (errors == best.min(2).sum(0)).all()
        sums, counts = tree.totals(books)
        for p in range(3):
            for e in range(m):
                own = parts[p][best[p].argmin(1) == e]
                assert counts[p, e] == len(own) and (sums[p, e] == own.sum(0)).all()
        nodes, _, at, _, _ = tree.walk(books)
        saved += 3 * n - len(at)
    assert saved > 2000  # parts that were assigned with a whole subtree


def test_sums_over_many_labels(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 50 if i % 50 else None, i) for i in range(1000)], "label int, error long")
    plain = sorted(map(str, codes.with_sum(rows, "label", "error", "s").collect()))
    monkeypatch.setattr(codes, "SMALL_ROWS", 10)
    assert sorted(map(str, codes.with_sum(rows, "label", "error", "s").collect())) == plain
