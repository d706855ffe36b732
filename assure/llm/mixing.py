"""Mixing sources to target weights: Pareto order sampling, in DataFrame operations only.

A document is expected in the mix e times: its source's target over its source's size, tilted by a weight of
its own if one is given. Its whole copies are certain; the fraction left, p, is the inclusion probability of
one more. With a uniform u from a hash, documents are ranked by (u / (1 - u)) / (p / (1 - p)), and each
source takes its ranking's head, as many words as its target still lacks. The place of the cut comes from
sums over two levels of rank buckets, so no source is ever sorted as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, packed, small, stored

BUCKETS = 1024


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5, 2, 1)  # of the sources in code point order, nulls last, repeating
    share: float = 1.5  # of all sizes, for all targets together
    most: int = 2  # times its size that a source, or a document, is taken at most
    seed: int = 20


def sizes(docs: DataFrame, mix: Mix = Mix(), tilt: Column | None = None) -> DataFrame:
    """docs with _size (words), _u (uniform in (0, 1), the same on each run), _tilt and _tie."""
    draw = F.xxhash64(F.lit(mix.seed), F.col("doc_id"), F.col("source"), F.col("text"))
    draw_tilt = F.lit(1) if tilt is None else tilt
    return docs.withColumns(
        {
            "_size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
            "_u": (F.shiftrightunsigned(draw, 11) + 0.5) / float(1 << 53),
            "_tilt": draw_tilt.cast("long"),
            "_tie": F.xxhash64(F.lit(mix.seed + 1), F.col("text")),
        }
    )


def targets(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """source, source_size, target and _tilted of each source: weights fill up under the caps (water level)."""
    by = sized.groupBy("source").agg(
        F.sum("_size").alias("source_size"), F.sum(F.col("_size") * F.col("_tilt")).alias("_tilted")
    )
    # one row a source from here on
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    n = len(mix.weights)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in mix.weights]), (place % n + 1).cast("int"))
    rows = by.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(mix.most)))
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(mix.share)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    rows = rows.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("w") * F.col("level"))
    water = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything)["level"]
    return rows.withColumn("water", water).select(
        "source", "source_size", "_tilted", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.col("water")).alias("target")
    )


def _ranked(sized: DataFrame, by_source: DataFrame, mix: Mix) -> DataFrame:
    """With _whole copies and the place in the ranking: _z in (0, 1), grows with the odds ratio; buckets _b1, _b2."""
    rows = sized.alias("d").join(by_source.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).drop(F.col("s.source"))
    expected = F.least(
        F.lit(float(mix.most)), F.coalesce(F.try_divide(F.col("target") * F.col("_tilt"), F.col("_tilted")), F.lit(0.0))
    )
    rows = rows.withColumn("_e", expected).withColumn("_whole", F.floor("_e").cast("long"))
    p = F.col("_e") - F.col("_whole")
    # a document of which nothing is left ranks last; z is q / (1 + q) for the odds ratio q
    odds, own = F.col("_u") * (1 - p), (1 - F.col("_u")) * p
    rows = rows.withColumn("_z", F.when(p > 0, odds / (odds + own)).otherwise(F.lit(1.0)))
    b1 = F.least(F.floor(F.col("_z") * BUCKETS), F.lit(BUCKETS - 1))
    rows = rows.withColumn("_b1", b1.cast("int"))
    b2 = F.least(F.floor((F.col("_z") * BUCKETS - F.col("_b1")) * BUCKETS), F.lit(BUCKETS - 1))
    return rows.withColumn("_b2", b2.cast("int"))


def _cut(sums: DataFrame, bucket: str, lacks: Column) -> DataFrame:
    """Of each source, the bucket in which its running sum reaches what it lacks, and the sum before it."""
    order = W.partitionBy("source").orderBy(bucket)
    run = sums.withColumn("_to", F.sum("_n").over(order))
    reached = run.where(F.col("_to") >= lacks)
    first = F.min_by(F.struct(F.col(bucket), (F.col("_to") - F.col("_n")).alias("_before")), F.col(bucket))
    return reached.groupBy("source").agg(first.alias("_cut")).select("source", f"_cut.{bucket}", "_cut._before")


def cuts(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """A row for each source: sizes, target, and where its ranking is cut (_c1, _c2) with the words lacking there."""
    by_source = stored(targets(sized, mix))
    ranked = _ranked(sized.select("doc_id", "source", "_size", "_u", "_tilt", "_tie"), small(by_source), mix)
    sums = stored(
        ranked.groupBy("source", "_b1").agg(F.sum("_size").alias("_n"), F.sum(F.col("_size") * F.col("_whole")).alias("_sure"))
    )
    sure = sums.groupBy("source").agg(F.sum("_sure").alias("_sure"))
    need = by_source.alias("s").join(sure.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        "s.*", (F.col("target") - F.col("_sure")).alias("_lack")
    )

    def with_need(rows: DataFrame, known: DataFrame, extra: str) -> DataFrame:
        joined = rows.alias("r").join(small(known).alias("k"), F.col("r.source").eqNullSafe(F.col("k.source")))
        return joined.select("r.*", f"k.{extra}")

    first = _cut(with_need(sums, need, "_lack"), "_b1", F.col("_lack"))
    need = need.alias("s").join(first.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")), "left").select(
        "s.*", F.col("c._b1").alias("_c1"), (F.col("_lack") - F.col("_before")).alias("_lack1")
    )
    need = stored(need)
    at = small(need.select("source", F.col("_c1"), F.col("_lack1")))
    inside = ranked.alias("r").join(
        at.alias("k"), F.col("r.source").eqNullSafe(F.col("k.source")) & (F.col("r._b1") == F.col("k._c1"))
    ).select("r.source", "r._b2", "r._size", "k._lack1")
    finer = inside.groupBy("source", "_b2").agg(F.sum("_size").alias("_n"), F.first("_lack1").alias("_lack1"))
    second = _cut(finer, "_b2", F.col("_lack1"))
    return need.alias("s").join(second.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")), "left").select(
        "s.source", "source_size", "_tilted", "target", "_c1", F.col("c._b2").alias("_c2"), (F.col("_lack1") - F.col("_before")).alias("_left")
    )


def copies(sized: DataFrame, cut: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """sized with _copies, source_size and target: whole copies, and one more for the head of each ranking."""
    rows = _ranked(sized, small(cut), mix)
    here = (F.col("_b1") == F.col("_c1")) & (F.col("_b2") == F.col("_c2"))
    head = F.coalesce(
        (F.col("_b1") < F.col("_c1")) | ((F.col("_b1") == F.col("_c1")) & (F.col("_b2") < F.col("_c2"))),
        F.col("_c1").isNull(),  # the ranking is shorter than what its source lacks
    )
    clear = rows.where(~F.coalesce(here, F.lit(False))).withColumn("_one", head & (F.col("_z") < 1))
    run = W.partitionBy("source").orderBy("_z", "doc_id", "_size", "_tie").rowsBetween(W.unboundedPreceding, -1)
    middle = F.coalesce(F.sum("_size").over(run), F.lit(0)) + F.col("_size") / 2
    edge = rows.where(here).withColumn("_one", (middle < F.col("_left")) & (F.col("_z") < 1))
    return clear.unionByName(edge).withColumn("_copies", F.col("_whole") + F.col("_one").cast("long"))


def taken(docs: DataFrame, mix: Mix = Mix(), tilt: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of each row of docs (doc_id, text, source).

    A null text has size 0 and a null source is a source of its own, last in order. Repeated rows draw the
    same number and are ranked beside each other; they get a row each. An empty table gives an empty one, a
    corpus without words zero targets; other columns are ignored. tilt, a whole number column, raises or
    lowers what is expected of a document within its source.
    """
    columns = ["doc_id", "source", "_size", "_u", "_tilt", "_tie"]
    sized = stored(sizes(docs, mix, tilt).select(*columns))
    got = copies(sized, cuts(sized, mix), mix)
    return got.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target",
        (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"),
    )


def mixed(docs: DataFrame, mix: Mix = Mix(), tilt: Column | None = None) -> DataFrame:
    """The mix: rows of docs, as often as they are taken, with their own columns."""
    columns = ["doc_id", "source", "_size", "_u", "_tilt", "_tie"]
    sized = sizes(docs, mix, tilt)
    cut = cuts(stored(sized.select(*columns)), mix)
    if tilt is not None:
        docs = docs.withColumn("_tilt", tilt)
    rows = sizes(packed(docs, "doc_id", "source", "text", *["_tilt"] * (tilt is not None)), mix, None if tilt is None else F.col("_tilt"))
    rows = copies(rows.drop("text"), cut, mix).where("_copies > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*[F.col("_row")[c].alias(c) for c in docs.columns if c != "_tilt"])
