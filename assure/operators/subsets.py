"""Which few credits of a small pool add up to a target: a table of all sums that a pool can reach, joined with the targets.

A pool of n credits (POOL at most) is an array in order of amount; a subset is a mask of its places. Each pool gives its
subsets of two to MEMBERS credits, made from its pairs and up to three later places: at most 760,058 rows, whatever the
number of targets. Those whose sum is a target are counted by sum, and targets meet the counts by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Credits up to which subsets are tried, and members of a subset.
POOL, MEMBERS = 40, 5


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def pools(credits: DataFrame, key: str) -> DataFrame:
    """key, n, ids, amounts of each pool of credits (key, bank_id, amount); places follow the amount, then the id."""
    sized = credits.groupBy(key).agg(F.count("*").alias("n"))
    small = sized.where(F.col("n") <= POOL).join(credits, key)  # no array of a pool that is too large
    rows = small.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("amount", "bank_id"))).alias("c"))
    return rows.select(key, F.size("c").alias("n"), F.col("c.bank_id").alias("ids"), F.col("c.amount").alias("amounts"))


def reachable(rows: DataFrame, key: str) -> DataFrame:
    """key, target, mask of each subset of two to MEMBERS places of each pool (rows: of pools())."""

    def later(i: Column) -> Column:
        return F.when(i + 1 < F.col("n"), F.sequence(i + 1, F.col("n") - 1)).otherwise(F.array().cast("array<int>"))

    def grown(s: Column, i: Column, left: int) -> Column:
        """The subset s, whose last place is i, and all that add up to `left` later places to it."""
        if not left:
            return F.array(s)

        def with_place(k: Column) -> Column:
            more = F.struct((s["target"] + F.get("amounts", k)).alias("target"), s["mask"].bitwiseOR(_bit(k)).alias("mask"))
            return grown(more, k, left - 1)

        return F.concat(F.array(s), F.flatten(F.transform(later(i), with_place)))

    first = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    pairs = first.select("*", F.explode(later(F.col("i"))).alias("j"))
    pair = F.struct((F.get("amounts", "i") + F.get("amounts", "j")).alias("target"), _bit(F.col("i")).bitwiseOR(_bit(F.col("j"))).alias("mask"))
    return pairs.withColumn("s", pair).select(key, F.inline(grown(F.col("s"), F.col("j"), MEMBERS - 2)))


def members(ids: Column, mask: Column) -> Column:
    """The ids at the places of mask."""
    return F.filter(ids, lambda _, i: mask.bitwiseAND(_bit(i)) != 0)


def subset_matches(credits: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """target_id, status, bank_id: the credits of the target's pool that two to MEMBERS of them can reach it with.

    credits: key, bank_id, amount; targets: key, target_id, target. If all credits of the pool add up to it, they are the
    answer. One subset is unique, several are ambiguous (a row for each credit of any). A pool of more than POOL credits
    is not searched: too_large, without a credit. A target that nothing reaches has no row.
    """
    of = pools(credits, key)
    wanted = targets.select(key, "target").distinct()
    found = reachable(of, key).join(wanted, [key, "target"], "left_semi").groupBy(key, "target").agg(F.count("*").alias("hits"), F.bit_or("mask").alias("mask"))
    total = of.select(key, "ids", F.aggregate("amounts", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
    met = targets.join(total, key).join(found, [key, "target"], "left")
    whole = (F.col("total") == F.col("target")) & (F.size("ids") > 0)
    status = F.when(whole | (F.col("hits") == 1), "unique").when(F.col("hits") > 1, "ambiguous")
    rows = met.withColumn("status", status).where("status IS NOT NULL")
    rows = rows.select("target_id", "status", F.explode(F.when(whole, F.col("ids")).otherwise(members(F.col("ids"), F.col("mask")))).alias("bank_id"))
    large = credits.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > POOL).select(key)
    refused = targets.join(large, key, "left_semi").select("target_id", F.lit("too_large").alias("status"), F.lit(None).cast("long").alias("bank_id"))
    return rows.unionByName(refused)
