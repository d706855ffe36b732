"""SimHash near-dedup: fingerprints linked at a small Hamming distance, candidates pruned by pigeonring chains.

A fingerprint is cut into m segments on a ring. If two fingerprints differ in at most t bits, some segment
starts a chain of which every prefix of l segments differs in at most floor(l * t / m) bits. For t = 2 and
m = 5 the first two segments of such a chain are equal: they are the join key. The longer prefixes are
checked next, the full distance last. Buckets over `most` fingerprints are not joined with themselves:
their fingerprints meet at the values one bit away from them, which is exact (two values within two bits
share one within one bit of both, and all that share one are within two bits), in rows linear in the bucket.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, small, stored, texts_of
from .components import components

BITS = 64
SEED = 42


def fingerprint(text: str, shingle: int = 3) -> int:
    """Of lower-cased (A-Z) words in shingles; fewer words: of the whole sequence; none: zero."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        starts = [0, *(ends[:-shingle] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist())]
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[k : k + (1 << 14)], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) of each row of docs (doc_id, text)."""

    def of_batch(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, shingle) for t in texts_of(batch)], np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": fps.view(np.int64)}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), of_batch, "doc_id long, fp long")


def segments(m: int) -> list[tuple[int, int]]:
    """First bit and width of each."""
    edges = [BITS * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(m: int, first: int, length: int) -> int:
    return sum(((1 << w) - 1) << a for a, w in (segments(m)[(first + k) % m] for k in range(length)))


def ring_fits(x: Column, y: Column, first: Column, m: int, most: int) -> Column:
    """Whether each longer chain from segment `first` keeps to its budget, and then the whole."""
    differ = x.bitwiseXOR(y)

    def within(k: int) -> Column:
        lengths = [n for n in range(1, m) if n * most // m > 0]
        return reduce(
            lambda a, b: a & b,
            [F.bit_count(differ.bitwiseAND(F.lit(_signed(_mask(m, k, n))))) <= n * most // m for n in lengths],
            F.lit(True),
        )

    chain = reduce(lambda rest, k: F.when(first == k, within(k)).otherwise(rest), range(m), F.lit(False))
    return chain & (F.bit_count(differ) <= most)


def links(distinct: DataFrame, most: int = 2, m: int = 5, bucket: int = 48) -> DataFrame:
    """Edges (a, b) that join exactly the values of distinct (fp) which links of `most` bits connect.

    most: 0, 1 or 2; what lies near a crowded bucket's values is exact up to a distance of 2.
    """
    if not 0 <= most <= 2:
        raise ValueError("crowded buckets are resolved for distances up to 2")
    if most == 0:  # equal values are one value
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    zero = [n for n in range(1, m + 1) if n * most // m == 0]
    equal = max(zero)  # segments that the key holds
    keys = stored(
        distinct.select(
            "fp",
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(k).alias("first"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(m, k, equal)))).alias("part"))
                        for k in range(m)
                    ]
                )
            ).alias("key"),
        ).select("fp", "key.first", "key.part")
    )
    sizes = keys.groupBy("first", "part").agg(F.count("*").alias("n")).where("n > 1")
    large = sizes.where(F.col("n") > bucket).select("first", "part")
    small = sizes.where(F.col("n") <= bucket).select("first", "part")

    some = stored(keys.join(small, ["first", "part"], "left_semi"))
    x, y = some.alias("x"), some.alias("y")
    pairs = x.join(
        y,
        (F.col("x.first") == F.col("y.first"))
        & (F.col("x.part") == F.col("y.part"))
        & (F.col("x.fp") < F.col("y.fp"))
        & ring_fits(F.col("x.fp"), F.col("y.fp"), F.col("x.first"), m, most),
    ).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))

    crowded = keys.join(large, ["first", "part"], "left_semi").select("fp").distinct()
    if most == 1:  # two values one bit apart: each is in the other's ball
        pairs_of = crowded.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(BITS)])).alias("value"))
        met = pairs_of.join(crowded.select(F.col("fp").alias("value")), "value").where("fp < value")
        return pairs.unionByName(met.select(F.col("fp").alias("a"), F.col("value").alias("b"))).distinct()
    ball = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(BITS)])
    # fingerprints of one crowd that have a value in common are linked to the least of them
    near = stored(crowded.select("fp", F.explode(ball).alias("value")))
    least = near.groupBy("value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("value", "a")
    stars = near.join(least, "value").where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) of each row of docs.

    A null text counts as empty, and a text without words has the fingerprint zero, which is linked like any
    other. Repeated rows and repeated doc_ids give a row each; an empty table gives an empty one; other
    columns are ignored. Copies share a fingerprint, so only distinct fingerprints are linked.
    """
    own = stored(fingerprints(docs, shingle))
    first = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(first.select("fp"), most))
    # the class of each linked fingerprint, then the smallest doc_id of each class
    linked = first.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_linked = linked.join(least, "root").select("fp", "component_id")
    of_fp = stored(
        first.join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    )
    return own.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = 5, most: int = 2) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id.

    Groups are what links of fingerprints connect. Rows without a doc_id come after all others, and those are told
    apart by their text; rows equal to the one that stays in doc_id and text stay with it. A null text counts as
    empty, and texts without words are copies of each other; an empty table gives an empty one.
    """
    text_key = F.xxhash64("text")

    def of_batch(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, shingle) for t in texts_of(batch)], np.uint64)
        return {"doc_id": batch.column("doc_id"), "t": batch.column("t"), "fp": fps.view(np.int64)}

    own = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key.alias("t"), "text"), of_batch, "doc_id long, t long, fp long")
    first = stored(own.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first")))
    roots = components(links(first.select("fp"), most)).withColumnRenamed("node", "fp")
    best = first.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    keys = stored(best.select(F.col("first.doc_id").alias("_near_id"), F.col("first.t").alias("_near_text")))
    return docs.join(small(keys), F.col("doc_id").cast("long").eqNullSafe(F.col("_near_id")) & (text_key == F.col("_near_text")), "left_semi")
