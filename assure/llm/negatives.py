"""Hard-negative mining: a full score sort for each anchor, read by binary search below each positive.

Anchors meet all rows in blocks. In a block, each anchor's whole scores are sorted, higher first and ties by id.
A first pass gives each anchor its positives, the best rows of its label. In the second the sorted scores of the
other labels are searched for the place where they come down to a positive's score, and the next entries are read
as long as they reach the lower limit. A block's first entries hold all that can be among the first of all blocks,
so the merge by rank is exact. Labels are only compared, never grouped by: a label with most rows makes no skew.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored
from .vectors import blocks_meet, inner, matrix, whole


@dataclass(frozen=True)
class Mining:
    scale: int = 256
    every: int = 100  # anchors are rows whose vec_id it divides
    positives: int = 5
    negatives: int = 5
    low: int = 80  # per cent of the positive's score that a negative reaches at least
    high: int = 100  # and at most
    block_rows: int = 1024
    anchor_rows: int = 2048


def relabelled(vec_id: Column, label: Column) -> Column:
    """The labels of the benchmark query: where 7 divides vec_id the next of ten."""
    label = label.cast("long")
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


class _Sorted:
    """A block's scores for each anchor, higher first, ties by smaller id."""

    def __init__(self, rows: pa.Table, anchors: pa.Table):
        dim = rows["dim"][0].as_py()
        ids = rows["vec_id"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[by_id], rows["label"].to_numpy()[by_id]
        self.anchor_ids, self.anchor_labels = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
        self.own = anchors["own"].to_numpy()
        self.scores = inner(matrix(anchors["v"], dim), matrix(rows["v"], dim)[by_id])

    def entries(self, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the rows that share anchor k's label or don't, best first; never rows of its own id."""
        among = np.flatnonzero(((self.labels == self.anchor_labels[k]) == same) & (self.ids != self.anchor_ids[k]))
        scores, ids = self.scores[k][among], self.ids[among]
        order = np.lexsort((ids, -scores))
        return scores[order], ids[order]


def _table(kinds: str, columns: list[np.ndarray]) -> pa.Table:
    fields = [c.split() for c in kinds.split(", ")]
    return pa.table({n: pa.array(x, pa.int32() if k == "int" else pa.int64()) for (n, k), x in zip(fields, columns)})


def _joined(parts: list[tuple], width: int) -> list[np.ndarray]:
    """Parts of scalars and equally long arrays, one below the other."""
    parts = [np.broadcast_arrays(*p) for p in parts]
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * width


def hard_negatives(vectors: DataFrame, label: Column | None = None, how: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of each anchor and positive.

    vectors: vec_id, embedding, label (or the column given). A row's score is its whole inner product with the anchor, of
    floor(scale * x). Positives: the anchor's best rows of the same label; negatives: the best rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. Ties go to the smaller vec_id. Rows whose id,
    label or vector is null, or with a null or non-finite component, take no part; vectors of different length do not
    meet. Rows of the anchor's own id are neither. Repeated rows each count, as anchors too. An anchor without positives or
    negatives has no rows; an empty table gives an empty one; other columns are ignored.
    """
    label = (F.col("label") if label is None else label).cast("long")
    known = vectors.where(F.col("vec_id").isNotNull() & label.isNotNull())
    rows = stored(whole(known, how.scale, label.alias("label")))
    anchors = rows.where(F.col("vec_id") % how.every == 0)

    def positives_of(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            block = _Sorted(left, right)
            for k, own in enumerate(block.own):
                scores, ids = block.entries(k, True)
                found.append((own, ids[: how.positives], scores[: how.positives]))
        return _table(first, _joined(found, 3))

    first = "own long, positive_id long, positive_score long"
    ranked = F.row_number().over(W.partitionBy("own").orderBy(F.desc("positive_score"), "positive_id"))
    best = blocks_meet(rows, anchors, positives_of, first, how.block_rows, how.anchor_rows).withColumn("place", ranked).where(F.col("place") <= how.positives)
    pairs = best.groupBy("own").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positive"))
    # the positives' ids and scores as two arrays: what an anchor asks of each block
    asked = stored(anchors.join(pairs, "own").select(*rows.columns, "positive.positive_id", "positive.positive_score"))

    def negatives_of(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            block = _Sorted(left, right)
            ids_, scores_ = right["positive_id"].to_pylist(), right["positive_score"].to_pylist()
            for k, own in enumerate(block.own):
                scores, ids = block.entries(k, False)
                for place, (positive, score) in enumerate(zip(ids_[k], scores_[k])):
                    # descending scores: from the first with 100 * n <= high * p, up to the last with 100 * n >= low * p
                    top = np.searchsorted(-scores, -(how.high * score // 100), "left")
                    end = np.searchsorted(-scores, how.low * -score // 100, "right")
                    part = slice(top, max(top, min(end, top + how.negatives)))
                    found.append((own, block.anchor_ids[k], place, positive, score, ids[part], scores[part]))
        return _table(second, _joined(found, 7))

    second = "own long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
    ranked = F.row_number().over(W.partitionBy("own", "place").orderBy(F.desc("negative_score"), "negative_id"))
    met = blocks_meet(rows, asked, negatives_of, second, how.block_rows, how.anchor_rows)
    chosen = met.withColumn("rank", ranked).where(F.col("rank") <= how.negatives)
    return chosen.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.own, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.own, place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.own = s.own AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT * FROM n WHERE rank <= 5
"""
