"""URLs and vectors of odd kinds: very long ones, repeated rows, clashing names, empty vectors."""

import numpy as np

from assure.llm import topk, url_filter


def test_urls(spark):
    long = "http://a.example.org/en/1" + "/x" * 30_000
    rows = [(1, long, "h", "v"), (1, long, "h", "v"), (2, "http://b.net/" + "y" * 70_000, "h", "v"), (None, "http://c.com/fr/1", "h", "v"), (3, None, None, None)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")).collect()
    assert len(got) == 5
    by = {r["page_id"]: r for r in got}
    assert by[1]["rule"] == "example.org/en/1" and by[1]["verdict"] == "block" and sum(r["page_id"] == 1 for r in got) == 2
    assert by[2]["rule"] is None and len(by[2]["path"]) == 70_001 and by[None]["rule"] == "com/fr/" and by[3]["host"] == ""


def test_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 6)).astype(np.float32)
    rows = [(i, [float(x) for x in v[i]], 1.0, 2) for i in range(400)] + [(450, [], 1.0, 2), (None, [1.0] * 6, 1.0, 2), (500, [], 1.0, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, dist double, pivot int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, index=topk.Index(pivots=5, annuli=4, block_rows=20, query_rows=3)).collect()}
    whole = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    for q in range(0, 400, 50):
        s = whole @ whole[q]
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:5]
        assert [got[q, k] for k in range(1, 6)] == [(i, int(s[i])) for i in best]
    assert got[450, 1] == (500, 0) and got[500, 1] == (450, 0) and len(got) == 42
