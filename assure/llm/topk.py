"""Exact top-k search: vectors keyed by nearest pivot and distance, annuli closed by triangle-inequality bounds.

A vector's components become whole numbers, floor(scale * x), and scores whole inner products. The index keys
each vector by its nearest pivot and, in annuli, by its distance from it; an annulus is stored in blocks of
bounded size. A query first scores one block of its own annulus, which gives it a k-th score to beat; it then
visits, nearest bounds first, only annuli whose best possible score reaches that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, stored
from .vectors import matrix, whole


@dataclass(frozen=True)
class Index:
    scale: int = 256
    pivots: int = 16  # sampled vectors, those with the smallest hashes; the zero vector for a length that has none
    annuli: int = 8  # of each pivot, of equal width
    block_rows: int = 512  # vectors in a block, on average
    query_rows: int = 4096  # queries that meet a block at once, on average


def _keyed(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows with pivot (its place in pivots of that length), dist and norm, both Euclidean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                m = matrix(part.column("v"), dim)
                p = pivots.get(dim, np.zeros((1, dim)))
                square = (m**2).sum(1)[:, None] - 2 * m @ p.T + (p**2).sum(1)[None, :]
                near = square.argmin(1)
                dist = np.sqrt(np.maximum(square[np.arange(len(m)), near], 0))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(near, pa.int32()), pa.array(dist), pa.array(np.sqrt((m**2).sum(1)))],
                    [*part.schema.names, "pivot", "dist", "norm"],
                )

    return rows.mapInArrow(run, "own long, vec_id long, dim int, v array<long>, pivot int, dist double, norm double")


def _best(ids: np.ndarray, m: np.ndarray, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of the candidates for each query that score `beat` at least, without rows of the query's own id."""
    queries, q, beat = asked["query_id"].to_numpy(), _stack(asked["q"]), asked["beat"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, m = ids[order], m[order]
    out = []
    for start in range(0, len(queries), 256):
        part = slice(start, start + 256)
        scores = np.where(ids[None, :] == queries[part, None], -np.inf, q[part] @ m.T)
        scores[scores < beat[part, None]] = -np.inf
        if scores.shape[1] > 4 * k:  # what can't be among the first k goes before the sort
            least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            row, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        else:
            row, col = np.nonzero(scores > -np.inf)
        s = scores[row, col]
        by = np.lexsort((col, -s, row))
        row, col, s = row[by], col[by], s[by]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        out.append(pd.DataFrame({"own": asked["own"].to_numpy()[part][row[keep]], "query_id": queries[part][row[keep]], "vec_id": ids[col[keep]], "score": s[keep].astype(np.int64)}))
    return pd.concat(out)


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, index: Index = Index()) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other vectors for each vec_id divisible by `every`.

    vectors: vec_id, embedding. Rows whose id or vector is null, or with a null or non-finite component, take
    no part; vectors of different length do not meet. Ties go to the smaller vec_id. Repeated rows, and rows
    that share an id, each count, as queries too (a result for each); rows of the query's own id do not. Exact
    while scores stay below 2**53; an empty table gives an empty one; other columns are ignored.
    """
    rows = stored(whole(vectors.where("vec_id IS NOT NULL"), index.scale))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(index.pivots).collect()
    pivots = {
        dim: np.array([r["v"] for r in sample if r["dim"] == dim], np.float64) for dim in {r["dim"] for r in sample}
    }
    keyed = stored(_keyed(rows, pivots))
    cell = ["dim", "pivot"]
    spans = keyed.groupBy(cell).agg(F.min("dist").alias("low"), F.max("dist").alias("high"))
    width = (F.col("high") - F.col("low")) / index.annuli
    annulus = F.when(width > 0, F.least(F.floor((F.col("dist") - F.col("low")) / width), F.lit(index.annuli - 1))).otherwise(0).cast("int")
    placed = keyed.join(small(stored(spans)), cell).withColumn("annulus", annulus).drop("low", "high")
    block = [*cell, "annulus"]
    sizes = stored(
        placed.groupBy(block).agg(
            F.count("*").alias("n"), F.min("dist").alias("d_min"), F.max("dist").alias("d_max"), F.max("norm").alias("n_max")
        )
    )
    subs = F.ceil(F.col("n") / index.block_rows).cast("int")
    stored_blocks = stored(
        placed.join(small(sizes.select(*block, subs.alias("subs"))), block).withColumn(
            "sub", F.pmod(F.xxhash64("own"), F.col("subs")).cast("int")
        )
    )
    candidates = stored_blocks.select(*block, "sub", "vec_id", "v")
    queries = stored_blocks.where(F.col("vec_id") % every == 0)
    chunks = -(-queries.count() // index.query_rows) or 1
    chunk = F.pmod(F.hash("own"), F.lit(chunks)).cast("int").alias("chunk")
    asked = queries.select(*block, "sub", "own", F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "norm", chunk)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("own", "query_id", "vec_id", "score")})
        return _best(left["vec_id"].to_numpy(), _stack(left["v"]), right, k)

    def scored(routed: DataFrame) -> DataFrame:
        """routed: block, sub, chunk, own, query_id, q, beat; each meets the vectors of its block."""
        key = [*block, "sub", "chunk"]
        # columns of their own: vectors and queries come from one table
        routed = routed.select(*[F.col(c).alias(c) for c in routed.columns])
        # a block is copied for the chunks that visit it, no others
        copies = candidates.join(stored(routed.select(*key).distinct()), [*block, "sub"])
        copies = copies.select(*[F.col(c).alias(c) for c in copies.columns])
        met = copies.groupBy(key).cogroup(routed.groupBy(key))
        return met.applyInPandas(score, "own long, query_id long, vec_id long, score long")

    own = scored(asked.withColumn("beat", F.lit(float("-inf"))))
    ranked = F.row_number().over(W.partitionBy("own").orderBy(F.desc("score"), "vec_id"))
    first = stored(own.withColumn("place", ranked).where(F.col("place") == k).select("own", F.col("score").cast("double").alias("beat")))
    known = stored(asked.join(first, "own", "left").withColumn("beat", F.coalesce("beat", F.lit(float("-inf")))))

    # all annuli: a bounded table, pivots * annuli rows for each vector length
    limits: dict[int, dict[str, np.ndarray]] = {}
    for r in sizes.withColumn("subs", subs).collect():
        limits.setdefault(r["dim"], []).append(r)
    limits = {
        dim: {c: np.array([r[c] for r in rs], np.float64 if c in ("d_min", "d_max", "n_max") else np.int64) for c in ("pivot", "annulus", "subs", "d_min", "d_max", "n_max")}
        for dim, rs in limits.items()
    }

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                q, at = matrix(part.column("q"), dim), limits[dim]
                p = pivots.get(dim, np.zeros((1, dim)))
                norm = part.column("norm").to_numpy()[:, None]
                inner = (q @ p.T)[:, at["pivot"]]
                d = np.sqrt(np.maximum((q**2).sum(1)[:, None] - 2 * q @ p.T + (p**2).sum(1)[None, :], 0))[:, at["pivot"]]
                gap = np.maximum(0, np.maximum(d - at["d_max"], at["d_min"] - d))
                most = np.minimum((norm**2 + at["n_max"] ** 2 - gap**2) / 2, norm * at["n_max"])
                most = np.minimum(most, inner + norm * at["d_max"])
                slack = 1 + 1e-9 * np.abs(most)
                row, col = np.nonzero(most + slack >= part.column("beat").to_numpy()[:, None])
                n = at["subs"][col]
                row, col, sub = np.repeat(row, n), np.repeat(col, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                for s in range(0, len(row), 8192):
                    r, c = row[s : s + 8192], col[s : s + 8192]
                    new = [pa.array(x, pa.int32()) for x in (np.full(len(r), dim), at["pivot"][c], at["annulus"][c], sub[s : s + 8192])]
                    yield pa.RecordBatch.from_arrays([*new, *[part.column(x).take(pa.array(r)) for x in ("chunk", "own", "query_id", "q", "beat")]], [*block, "sub", "chunk", "own", "query_id", "q", "beat"])

    kinds = "dim int, pivot int, annulus int, sub int, chunk int, own long, query_id long, q array<long>, beat double"
    routed = known.select("dim", "chunk", "own", "query_id", "q", "norm", "beat").mapInArrow(route, kinds)
    best = scored(routed).withColumn("rank", ranked).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
