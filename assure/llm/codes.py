"""Vector code compression: codebooks by filtering Lloyd, kd-trees with cached sums built once and read in every round.

Vectors of whole components are cut into equal parts, each with a codebook of its own. Every partition builds, over
blocks of its rows, a kd-tree for each part; a node holds its bounding box, the sum and the number of its parts. The
trees are stored. In a round, each tree is walked from its roots with all entries as candidates: an entry is eliminated
where no point of the box is nearer to it than to the entry nearest the box's middle. A node with one candidate left is
assigned as a whole, by its cached sum and count; otherwise its children go on with the candidates that are left. All
arithmetic is in whole numbers, with ties to the lower index, so the result is that of plain Lloyd.

A round gives the driver one sum for each component of each codebook, whatever the number of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SMALL_ROWS, stored
from .vectors import matrix, whole


@dataclass(frozen=True)
class Coding:
    scale: int = 4096
    parts: int = 8
    entries: int = 16  # at most 256: a code is two hex digits
    rounds: int = 6
    block_rows: int = 4096  # rows of a tree
    leaf: int = 8  # parts in a leaf, about


#: Components beyond this would overflow the squared distances of 64-bit numbers.
LARGEST = 1 << 26


@dataclass
class Forest:
    """A kd-tree for each part of a block of n rows. points are in the order of the trees, those of part k from k * n."""

    n: int
    points: np.ndarray
    order: np.ndarray  # the row of each point
    start: np.ndarray  # of each node's points
    stop: np.ndarray
    left: np.ndarray  # of its two children; 0 for a leaf
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @classmethod
    def build(cls, parts: np.ndarray, leaf: int) -> Forest:
        """parts: k x n x width whole numbers. All trees grow together, level by level, split at the median of the widest side."""
        k, n, width = parts.shape
        points, order = parts.reshape(k * n, width), np.tile(np.arange(n), k)
        start, stop = np.arange(k) * n, np.arange(1, k + 1) * n
        levels, made = [], 0
        while len(start):
            own = _ranges(start, stop)
            sizes = stop - start
            cuts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            at = points[own]
            low, high, sums = (f.reduceat(at, cuts, axis=0) for f in (np.minimum, np.maximum, np.add))
            split = (sizes > leaf) & (high > low).any(axis=1)
            made += len(start)
            left = np.where(split, made + 2 * (np.cumsum(split) - 1), 0)
            levels.append((start, stop, left, low, high, sums))
            start, stop, widest = start[split], stop[split], (high - low)[split].argmax(axis=1)
            if len(start):
                own, node = _ranges(start, stop), np.repeat(np.arange(len(start)), stop - start)
                by = own[np.lexsort((points[own, widest[node]], node))]
                points[own], order[own] = points[by], order[by]
                middle = (start + stop) // 2
                start, stop = np.stack([start, middle], 1).ravel(), np.stack([middle, stop], 1).ravel()
        return cls(n, points, order, *(np.concatenate(x) for x in zip(*levels)))

    def walk(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """books: parts x entries x width. The nodes assigned as a whole, their entries; points of leaves one by one, theirs; eliminated candidates."""
        node = np.arange(len(books))
        alive = np.ones(books.shape[:2], bool)
        done, points, gone = [], [], 0
        while len(node):
            part = self.start[node] // max(self.n, 1)
            low, high, c = self.low[node][:, None], self.high[node][:, None], books[part]
            to_middle = np.where(alive, ((low + high - 2 * c) ** 2).sum(2), np.iinfo(np.int64).max)
            near = to_middle.argmin(1)
            best = c[np.arange(len(node)), near][:, None]
            way = c - best
            corner = np.where(way > 0, high, low)
            # what the squared distance to an entry exceeds that to the nearest by, at the corner where it does least
            excess = (c**2).sum(2) - (best**2).sum(2) - 2 * (corner * way).sum(2)
            index = np.arange(c.shape[1])
            lost = alive & ((excess > 0) | ((excess == 0) & (index > near[:, None]))) & (index != near[:, None])
            alive &= ~lost
            gone += int(lost.sum())
            one = alive.sum(1) == 1
            done.append((node[one], alive[one].argmax(1)))
            leaves = ~one & (self.left[node] == 0)
            if leaves.any():
                points.append(self._one_by_one(node[leaves], alive[leaves], books))
            on = ~one & ~leaves
            first = self.left[node[on]]
            node, alive = np.stack([first, first + 1], 1).ravel(), np.repeat(alive[on], 2, axis=0)
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return *(np.concatenate(x) for x in zip(none, *done)), *(np.concatenate(x) for x in zip(none, *points)), np.int64(gone)

    def _one_by_one(self, node: np.ndarray, alive: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = _ranges(self.start[node], self.stop[node])
        mine = np.repeat(alive, self.stop[node] - self.start[node], axis=0)
        square = ((self.points[at][:, None] - books[at // self.n]) ** 2).sum(2)
        return at, np.where(mine, square, np.iinfo(np.int64).max).argmin(1)

    def totals(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum and number of the parts that each entry of each codebook is nearest to."""
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        nodes, entry, at, each, _ = self.walk(books)
        np.add.at(sums, (self.start[nodes] // self.n, entry), self.sums[nodes])
        np.add.at(counts, (self.start[nodes] // self.n, entry), self.stop[nodes] - self.start[nodes])
        np.add.at(sums, (at // self.n, each), self.points[at])
        np.add.at(counts, (at // self.n, each), 1)
        return sums, counts

    def assigned(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows x parts: the nearest entry, and each row's squared distances summed over its parts."""
        nodes, entry, at, each, _ = self.walk(books)
        found = np.empty(len(self.points), np.int64)
        found[_ranges(self.start[nodes], self.stop[nodes])] = np.repeat(entry, self.stop[nodes] - self.start[nodes])
        found[at] = each
        part = np.arange(len(found)) // self.n
        codes, errors = np.empty((self.n, len(books)), np.uint8), np.zeros(self.n, np.int64)
        codes[self.order, part] = found
        np.add.at(errors, self.order, ((self.points - books[part, found]) ** 2).sum(1))
        return codes, errors


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """start[0], ..., stop[0] - 1, start[1], ..."""
    sizes = stop - start
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - sizes), sizes)


ARRAYS = ("points", "order", "start", "stop", "left", "low", "high", "sums")


def padded(v: Column, parts: int) -> Column:
    """A vector with zeros up to a length that the parts divide, one component a part at least."""
    width = F.greatest(F.ceil(F.size(v) / parts).cast("int"), F.lit(1))
    return F.concat(v, F.array_repeat(F.lit(0).cast("long"), width * parts - F.size(v)))


def forests(rows: DataFrame, how: Coding) -> DataFrame:
    """A row for each block of rows of one dim: dim, n, own, vec_id, label, and the arrays of its forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                same = batch.filter(pa.array(dims == dim))
                for at in range(0, same.num_rows, how.block_rows):
                    block = same.slice(at, how.block_rows)
                    m = matrix(block.column("v"), len(block.column("v")[0]), np.int64)
                    if np.abs(m).max(initial=0) > LARGEST:
                        raise OverflowError(f"components beyond {LARGEST} (scaled) have no exact distances in 64 bits")
                    tree = Forest.build(m.reshape(len(m), how.parts, -1).transpose(1, 0, 2).copy(), how.leaf)
                    lists = [pa.array([getattr(tree, x).ravel()], pa.list_(pa.int64())) for x in ARRAYS]
                    kept = [pa.ListArray.from_arrays(pa.array([0, len(block)], pa.int32()), block.column(c)) for c in ("vec_id", "label")]
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(m)], pa.int32()), *kept, *lists], ["dim", "n", "vec_id", "label", *ARRAYS])

    lists = ", ".join(f"{x} array<long>" for x in ARRAYS)
    return rows.select("dim", "vec_id", "label", "v").mapInArrow(run, f"dim int, n int, vec_id array<long>, label array<{rows.schema['label'].dataType.simpleString()}>, {lists}")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, Forest]]:
    """The stored forests one by one: the row, its dim and the forest."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            flat = {x: row.column(x).flatten().to_numpy() for x in ARRAYS}
            nodes, n = len(flat["start"]), row.column("n")[0].as_py()
            tall = {"points": -1, "low": nodes, "high": nodes, "sums": nodes}
            width = len(flat["low"]) // nodes
            yield row, row.column("dim")[0].as_py(), Forest(n, **{x: a.reshape(-1, width) if x in tall else a for x, a in flat.items()})


def codebooks(rows: DataFrame, trees: DataFrame, how: Coding) -> dict[int, np.ndarray]:
    """By dim, the codebooks after all rounds: parts x entries x width. Vector lengths are taken to be few."""
    # fixed by ties to the lesser vector, so that repeated ids start alike
    place = F.row_number().over(W.partitionBy("dim").orderBy(F.asc_nulls_last("vec_id"), "v"))
    first: dict[int, list] = {}
    for r in rows.withColumn("place", place).where(F.col("place") <= how.entries).orderBy("dim", "place").select("dim", "v").collect():
        first.setdefault(r["dim"], []).append(r["v"])
    books = {dim: np.array(v, np.int64).reshape(len(v), how.parts, -1).transpose(1, 0, 2).copy() for dim, v in first.items()}
    for _ in range(how.rounds):
        now = dict(books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for _, dim, tree in _each(batches):
                sums, counts = tree.totals(now[dim])
                had = held.get(dim)
                held[dim] = [had[0] + sums, had[1] + counts] if had else [sums, counts]
            for dim, (sums, counts) in held.items():
                part, entry = counts.nonzero()
                lists = pa.array(list(sums[part, entry]), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), dim), pa.int32()), pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), lists], names)

        names = ["dim", "part", "entry", "n", "sums"]
        sums = trees.select("dim", "n", *ARRAYS).mapInArrow(run, "dim int, part int, entry int, n long, sums array<long>")
        each = sums.select("dim", "part", "entry", "n", F.posexplode("sums").alias("pos", "x"))
        for r in each.groupBy("dim", "part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
            books[r["dim"]][r["part"], r["entry"], r["pos"]] = r["x"] // r["n"]
    return books


def with_sum(rows: DataFrame, by: str, value: str, name: str, salts: int = 32) -> DataFrame:
    """rows with the sum of value over all rows with the same `by`, nulls together; many sums are joined on a salted key."""
    sums = stored(rows.groupBy(by).agg(F.sum(value).alias(name))).select(F.col(by).alias("_by"), name)
    if sums.count() <= SMALL_ROWS:
        return rows.join(F.broadcast(sums), rows[by].eqNullSafe(sums["_by"])).drop("_by")
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    sums = sums.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(sums, salted[by].eqNullSafe(sums["_by"]) & (salted["_salt"] == sums["_of"])).drop("_by", "_salt", "_of")


def compressed(vectors: DataFrame, how: Coding = Coding()) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """vec_id, label, dim, code (a byte a part), error of each row that takes part; and the codebooks by dim."""
    label = F.col("label")
    kept = whole(vectors, how.scale, label.alias("label"))
    rows = stored(kept.withColumn("v", padded(F.col("v"), how.parts)))
    trees = stored(forests(rows, how))
    books = codebooks(rows, trees, how)
    kind = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, dim, tree in _each(batches):
            codes, errors = tree.assigned(books[dim])
            kept = [row.column(c).flatten() for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(tree.n, dim), pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors, kind)], ["vec_id", "label", "dim", "code", "error"])

    label_kind = rows.schema["label"].dataType.simpleString()
    return trees.mapInArrow(run, f"vec_id long, label {label_kind}, dim int, code binary, error long"), books


def restored(codes: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """codes (dim, code and any others) with v, the entries that the code names, one part after the other."""
    table = [(dim, [[e.tolist() for e in part] for part in book]) for dim, book in books.items()]
    held = codes.sparkSession.createDataFrame(table, "dim int, book array<array<array<long>>>")
    digits = F.transform(F.sequence(F.lit(1), F.length("code")), lambda i: F.conv(F.hex(F.substring(F.col("code"), i, F.lit(1))), 16, 10).cast("int"))
    parts = F.zip_with("book", digits, lambda entries, k: F.get(entries, k))
    return codes.join(F.broadcast(held), "dim").withColumn("v", F.flatten(parts)).drop("book")


def vector_codes(vectors: DataFrame, how: Coding = Coding()) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each row of vectors (vec_id, embedding, label).

    code: two hex digits a part. error: squared distances to the entries, summed over the parts. label_error: error over all
    rows of that label, nulls together. Rows whose vector is null or holds a null or non-finite component take no part; a
    null vec_id comes after all others. Codebooks start from the rows of the smallest ids (all, if there are fewer than
    entries; of equal ids the lesser vector first), so repeated rows may give equal entries, of which the first is used.
    Vectors of another length have codebooks of their own; a length that the parts do not divide is filled up with zeros. An
    empty table gives an empty one; other columns are ignored. Scaled components beyond 2**26 raise OverflowError.
    """
    rows, books = compressed(vectors, how)
    if not books:
        return rows.select("vec_id", F.hex("code").alias("code"), "error", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    digests = {dim: hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest() for dim, book in books.items()}
    digest = F.create_map(*[F.lit(x) for pair in digests.items() for x in pair])[F.col("dim")]
    rows = with_sum(stored(rows), "label", "error", "label_error")
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def sql(how: Coding = Coding()) -> str:
    """The same by plain Lloyd, a round for each pair of common tables."""
    k, m = how.parts, how.entries
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS own, vec_id, label, list_transform(embedding, lambda x: CAST(floor({how.scale} * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT own, vec_id, label, part, v[CAST(part * len(v) // {k} + 1 AS BIGINT) : CAST((part + 1) * len(v) // {k} AS BIGINT)] AS x, v FROM v, range({k}) t(part))",
        f"c0 AS MATERIALIZED (SELECT part, place - 1 AS entry, x AS c FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id, v) AS place FROM p) WHERE place <= {m})",
    ]
    for r in range(how.rounds + 1):
        d = f"list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"a{r} AS MATERIALIZED (SELECT own, part, any_value(vec_id) AS vec_id, any_value(label) AS label, any_value(x) AS x, CAST(min({d} * {m} + entry) AS BIGINT) AS best FROM p JOIN c{r} USING (part) GROUP BY own, part)")
        if r < how.rounds:
            mean = f"SELECT part, best % {m} AS entry, pos, CAST(floor(sum(x[pos])::DOUBLE / count(*)) AS BIGINT) AS y FROM a{r}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS pos) GROUP BY ALL"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT part, entry, list(y ORDER BY pos) AS c FROM ({mean}) GROUP BY part, entry) m USING (part, entry))")
    last = how.rounds
    steps.append(f"e AS (SELECT own, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(printf('%02x', best % {m}), '' ORDER BY part) AS code, CAST(sum(best // {m}) AS BIGINT) AS error FROM a{last} GROUP BY own)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{last})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e, h"
