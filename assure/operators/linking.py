"""The four linking passes: identity, exact amount and date, grouped sums, tolerance bands.

Chains (pending) have recon rows and no bank leg; banks are credits that no identity claims. A pass claims a
pair only if it is the only one from both sides; ties are reported and leave both pools.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assure.functions.dates import within_days
from assure.functions.money import Tolerance, sum_paise
from assure.functions.text import record_key
from assure.operators.subsets import POOL, members, reachable
from assure.sources.readers import numbered
from assure.sources.shared import written

# The sides of a chain; confidence of each pass in basis points, its rule, and the order in which their groups are numbered.
SIDES = ("intent", "razorpay", "bank")
CONFIDENCE = {"P0": 10_000, "P1": 9_500, "P2": 9_000, "P3": 7_000}
RULE = {"P0": "ID_CHAIN", "P1": "EXACT_COMPOSITE", "P2": "GROUP_SUBSET_SUM", "P3": "TOL_BAND"}


def record_edges(records) -> DataFrame:
    """key, field, value: by what each record joins others. records: anything with the canonical tables."""

    def of(table: str, prefix: str, number: str, *edges: tuple[str, Column]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(field).alias("field"), value.alias("value")) for field, value in edges])).alias("e")
        return records.table(table).select(record_key(prefix, number).alias("key"), each).select("key", "e.*").where("value is not null")

    order, payment, transfer = record_key("ord", "order_id"), record_key("pay", "payment_id"), record_key("trf", "transfer_id")
    parts = (
        of("intent", "ord", "k", ("order_id", record_key("ord", "k"))), of("intent", "int", "k", ("order_id", record_key("ord", "k"))),
        of("payment", "pay", "payment_id", ("order_id", order), ("payment_id", payment)), of("transfer", "trf", "transfer_id", ("payment_id", payment), ("transfer_id", transfer)),
        of("refund", "rfnd", "refund_id", ("payment_id", payment)), of("reversal", "rvsl", "reversal_id", ("transfer_id", transfer)),
        of("dispute", "disp", "dispute_id", ("payment_id", payment)), of("recon", "rcn", "recon_id", ("utr", F.col("utr")), ("transfer_id", transfer)),
        of("bank", "bank", "bank_id", ("utr", F.col("utr"))),
    )
    return reduce(DataFrame.unionByName, parts)


def join_edges(orders: DataFrame, recon: DataFrame, bank: DataFrame, bank_node: int) -> DataFrame:
    """node, value: what links whole order chains and bank credits to each other, their settlement references.

    Orders are nodes by their key; banks follow from bank_node on. Records below an order have one parent each, so
    plain joins have put them in their order's chain already.
    """
    chains = orders.select(F.col("k").alias("node"), F.lit(None).cast("string").alias("value"))
    by_recon = recon.select(F.col("transfer_id").alias("node"), F.col("utr").alias("value"))
    by_bank = bank.select((F.col("bank_id") + F.lit(bank_node)).alias("node"), F.col("utr").alias("value"))
    return chains.unionByName(by_recon).unionByName(by_bank)


def route(members: DataFrame) -> DataFrame:
    """component, kind, target_paise, settlement_id, settled of each component.

    members: component, ord, side (of SIDES), credit, debit, settlement_id, settled (the last four of recon rows only).
    With a recon row and no bank leg a chain is pending, whatever its sides; else two sides make a group. Sides are told by
    flags, so that members are summed before the one shuffle.
    """
    first = lambda c: F.min_by(F.when(F.col("credit").isNotNull(), F.col(c)), F.when(F.col("credit").isNotNull(), F.col("ord")))
    seen = members.groupBy("component").agg(
        *[F.bool_or(F.col("side") == s).alias(s) for s in SIDES], F.count("credit").alias("recons"),
        sum_paise(F.col("credit") - F.col("debit")).alias("target_paise"), first("settlement_id").alias("settlement_id"), first("settled").alias("settled"),
    )
    sides = reduce(Column.__add__, [F.col(s).cast("int") for s in SIDES])
    kind = F.when((F.col("recons") > 0) & ~F.col("bank"), "pending").when(sides >= 2, "group").otherwise("remaining")
    return seen.withColumn("kind", kind).drop(*SIDES)


@dataclass
class Attached:
    claimed: DataFrame  # pending_id, bank_id
    tied: DataFrame  # pending_id, bank_id of every candidate of an ambiguous chain
    pending: DataFrame
    banks: DataFrame


def attach(pending: DataFrame, banks: DataFrame, pairs: DataFrame) -> Attached:
    """Claim the pairs (pending_id, bank_id) that are unique from both sides; both sides of ties leave the pools.

    Claims, ties and what is left all read the pairs, which are written once.
    """
    one_p, one_b = W.partitionBy("pending_id"), W.partitionBy("bank_id")
    degrees = written(pairs.withColumn("dp", F.count("*").over(one_p)).withColumn("db", F.count("*").over(one_b)))
    unique = (F.col("dp") == 1) & (F.col("db") == 1)
    claimed, tied = degrees.where(unique).select("pending_id", "bank_id"), degrees.where(~unique).select("pending_id", "bank_id")
    return Attached(claimed, tied, pending.join(degrees, "pending_id", "left_anti"), banks.join(degrees, "bank_id", "left_anti"))


@dataclass
class Alike:
    """attach() without the pairs of ties: all chains of one amount and day meet the same credits."""

    claimed: DataFrame  # pending_id, bank_id
    tied: DataFrame  # pending_id, bank_id of every candidate of an ambiguous chain; its pairs are made where it is read
    torn: DataFrame  # pending_id, first (named, key, amount) of the candidates of an ambiguous chain
    pending: DataFrame
    banks: DataFrame


def attach_alike(pending: DataFrame, banks: DataFrame, near: Callable[..., DataFrame]) -> Alike:
    """attach() of the pairs that near gives, which are told by amounts and days alone: made once for equal chains and equal credits.

    pending: pending_id, target_paise, settled; banks: bank_id, amount, credited, named; ids are unique. Where n chains and m credits
    are alike, they are one pair of values with its counts, not n * m pairs.
    """
    first = F.struct("named", record_key("bank", "bank_id").alias("key"), "amount")
    chains = written(pending.groupBy("target_paise", "settled").agg(F.min("pending_id").alias("pending_id"), F.count("*").alias("chains")))
    credits = written(banks.groupBy("amount", "credited").agg(F.min("bank_id").alias("bank_id"), F.count("*").alias("credits"), F.min(first).alias("first")))
    one_p, one_b = W.partitionBy("pending_id"), W.partitionBy("bank_id")
    met = near(chains, credits, "chains", "credits").withColumn("dp", F.sum("credits").over(one_p)).withColumn("db", F.sum("chains").over(one_b))
    met = written(met.select("pending_id", "bank_id", ((F.col("dp") == 1) & (F.col("db") == 1)).alias("unique")))
    pairs = met.where("not unique").select("pending_id", "bank_id")
    of_chain = chains.select(F.col("pending_id").alias("p"), "target_paise", "settled")
    of_credit = credits.select(F.col("bank_id").alias("b"), "amount", "credited", "first")
    alike = pending.select("pending_id", "target_paise", "settled").join(of_chain, ["target_paise", "settled"]).select("pending_id", "p")
    same = banks.select("bank_id", "amount", "credited").join(of_credit.drop("first"), ["amount", "credited"]).select("bank_id", "b")
    tied = pairs.toDF("p", "b").join(alike, "p").join(same, "b").select("pending_id", "bank_id")
    torn = pairs.toDF("p", "b").join(of_credit.select("b", "first"), "b").groupBy("p").agg(F.min("first").alias("first")).join(alike, "p").select("pending_id", "first")
    gone_p = of_chain.join(met.select(F.col("pending_id").alias("p")), "p", "left_semi").select("target_paise", "settled")
    gone_b = of_credit.join(met.select(F.col("bank_id").alias("b")), "b", "left_semi").select("amount", "credited")
    return Alike(
        met.where("unique").select("pending_id", "bank_id"), tied, torn, pending.join(gone_p, ["target_paise", "settled"], "left_anti"), banks.join(gone_b, ["amount", "credited"], "left_anti")
    )


def exact_pairs(pending: DataFrame, banks: DataFrame, *more: str) -> DataFrame:
    """P1: equal amounts on equal days. more: further columns of either side that the pairs keep."""
    b = banks.select("bank_id", F.col("amount").alias("target_paise"), F.col("credited").alias("settled"), *[c for c in more if c in banks.columns])
    return pending.join(b, ["target_paise", "settled"]).select("pending_id", "bank_id", *more)


def band_pairs(pending: DataFrame, banks: DataFrame, *more: str, tolerance: Tolerance = Tolerance()) -> DataFrame:
    """P3: amounts within the target's band, days within the window, by equi-join on day and amount bucket.

    Buckets are as wide as the next power of two above twice the target's band, so a chain looks into its own and at most
    one neighbour. Bands are a share of the amount: a credit stands in the one or two sizes of bucket that chains near it use.
    """
    if not 0 <= tolerance.rel_bps <= 5000:
        raise ValueError("a band is at most half of the amount")

    def size(expected: Column) -> Column:
        """Bits of a bucket for a target."""
        return F.length(F.bin(tolerance.band(expected) * 2))

    def bucket(amount: Column, bits: Column) -> Column:
        return F.call_function("shiftright", amount, bits)

    days = F.explode(F.sequence(F.lit(-tolerance.days), F.lit(tolerance.days)))
    bits, band = size(F.col("target_paise")), tolerance.band("target_paise")
    edges = F.array_distinct(F.array(bucket(F.col("target_paise") - band, bits), bucket(F.col("target_paise") + band, bits)))
    spread = pending.select("*", days.alias("shift")).withColumn("credited", F.date_add("settled", F.col("shift")))
    spread = spread.select("*", bits.alias("bits"), F.explode(edges).alias("bucket"))
    # the largest and the smallest target that can have this credit in its band
    slack = tolerance.band("amount") * 2 + 2
    least, most = F.greatest(F.abs("amount") - slack, F.lit(0)), F.abs("amount") + slack
    sizes = F.explode(F.sequence(size(least), size(most)))
    placed = banks.select("bank_id", "amount", "credited", *[c for c in more if c in banks.columns], sizes.alias("bits"))
    placed = placed.select("*", bucket(F.col("amount"), F.col("bits")).alias("bucket"))
    near = spread.join(placed, ["credited", "bits", "bucket"])
    return near.where(tolerance.within("target_paise", "amount") & within_days("settled", "credited", tolerance.days)).select("pending_id", "bank_id", *more)


def settlements(pending: DataFrame) -> DataFrame:
    """settlement_id, place (of its first chain) and summed target of the pending chains."""
    return pending.groupBy("settlement_id").agg(F.min("pending_id").alias("place"), sum_paise("target_paise").alias("target"))


@dataclass
class Sums:
    """What P2 decides. Settlements whose sum several credits have are held with that sum: each of these credits is a candidate."""

    unique: DataFrame  # settlement_id, bank_id
    torn: DataFrame  # settlement_id, target, first (named, key, amount) of the credits of that amount
    turned: DataFrame | None  # settlement_id, status, bank_id of those tried in turn on few credits

    def rows(self, banks: DataFrame) -> DataFrame:
        """settlement_id, status, bank_id of every candidate."""
        several = self.torn.select("settlement_id", "target").join(banks.select("bank_id", F.col("amount").alias("target")), "target")
        rows = self.unique.select("settlement_id", F.lit("unique").alias("status"), "bank_id").unionByName(several.select("settlement_id", F.lit("ambiguous").alias("status"), "bank_id"))
        return rows if self.turned is None else rows.unionByName(self.turned)


def grouped_sums(sums: DataFrame, banks: DataFrame) -> DataFrame:
    """P2: settlement_id, status, bank_id of each settlement with a candidate.

    sums: settlement_id, place, target. A single credit equal to a settlement's sum decides first: if it is
    the only free one, the earliest settlement with that sum claims it; several are a tie for each of them.
    Subsets are tried only where no more than POOL credits are left. Until a claim leaves that few, only single credits
    decide, in a closed form. Places are distinct.
    """
    return decided_sums(sums, banks).rows(banks)


def decided_sums(sums: DataFrame, banks: DataFrame) -> Sums:
    """grouped_sums(), its ties by their sums."""
    banks = _named(banks)
    extra = banks.count() - POOL  # claims after which subsets are tried
    first = F.struct("named", record_key("bank", "bank_id").alias("key"), "amount")
    same = banks.groupBy(F.col("amount").alias("target")).agg(F.count("*").alias("free"), F.min("bank_id").alias("only"), F.min(first).alias("first"))
    turn = F.row_number().over(W.partitionBy("target").orderBy("place"))
    met = sums.withColumn("turn", turn).join(same, "target").checkpoint()
    if extra <= 0:
        return _closed(met.limit(0), met.limit(0), _in_turn(sums, banks))
    won = met.where((F.col("free") == 1) & (F.col("turn") == 1))
    claims = won.count()
    if claims < extra:
        return _closed(met, won)
    # the place of claim number `extra`, counted from the last: POOL + 1 rows at most
    turning = won.select("place").orderBy(F.desc("place")).limit(claims - extra + 1).agg(F.min("place")).first()[0]
    early = won.where(F.col("place") <= turning)
    left = banks.join(early.select(F.col("only").alias("bank_id")), "bank_id", "left_anti")
    return _closed(met.where(F.col("place") <= turning), early, _in_turn(sums.where(F.col("place") > turning), left))


def _named(banks: DataFrame) -> DataFrame:
    """banks with named, by what the first of tied credits is chosen: its key, unless it is given."""
    return banks if "named" in banks.columns else banks.withColumn("named", record_key("bank", "bank_id"))


def _closed(met: DataFrame, won: DataFrame, turned: DataFrame | None = None) -> Sums:
    """What settlements that meet single credits (met), of which won claim theirs, come to."""
    return Sums(won.select("settlement_id", F.col("only").alias("bank_id")), met.where("free > 1").select("settlement_id", "target", "first"), turned)


def _in_turn(sums: DataFrame, banks: DataFrame) -> DataFrame:
    """Settlements in turn against what is still free of at most POOL credits.

    What a target can have depends on the credits that are free, and these change only with a claim. So each round looks up
    the first later settlement whose answer is unique, for all at once in the table of reachable sums; after the last
    claim (POOL at most), every settlement meets the table of its own turn.
    """
    pool = banks.select("amount", "bank_id").orderBy("amount", "bank_id").collect()  # bounded: POOL rows at most
    spark, ids, amounts = sums.sparkSession, [r["bank_id"] for r in pool], [r["amount"] for r in pool]
    whole = spark.createDataFrame([(0, len(ids), ids, amounts)], "p int, n int, ids array<long>, amounts array<long>")
    single = spark.createDataFrame([(a, 1 << i, True) for i, a in enumerate(amounts)], "target long, mask long, single boolean")
    every = single.unionByName(reachable(whole, "p").select("target", "mask", F.lit(False).alias("single")))
    near = every.join(sums.select("target").distinct(), "target", "left_semi").checkpoint()

    def answers(rows: DataFrame, turns: list[int], *by: str) -> DataFrame:
        """by, target, hits, mask: what decides about a target, in rows (near of each turn, with the turn's free credits)."""
        one = F.col("single")
        of = rows.where(F.col("mask").bitwiseAND(F.bitwise_not(F.col("free"))) == 0).groupBy(*by, "target").agg(
            F.count_if(one).alias("ones"), F.bit_or(F.when(one, F.col("mask"))).alias("one"), F.count("*").alias("hits"), F.bit_or("mask").alias("any")
        )
        sums_of = [(k, sum(a for i, a in enumerate(amounts) if free >> i & 1), free) for k, free in enumerate(turns) if free]
        all_free = spark.createDataFrame(sums_of, "turn int, target long, all long").select(*by, "target", "all")
        both = of.join(all_free, [*by, "target"], "full")
        taken = F.when(F.col("ones") > 0, F.col("one")).otherwise(F.coalesce("all", "any"))
        hits = F.when(F.col("ones") > 0, F.col("ones")).when(F.col("all").isNotNull(), 1).otherwise(F.col("hits"))
        return both.select(*by, "target", hits.alias("hits"), taken.alias("mask"))

    turns, places = [(1 << len(ids)) - 1], []
    while turns[-1]:
        later = sums.where(F.col("place") > places[-1]) if places else sums
        unique = answers(near.withColumn("free", F.lit(turns[-1])), turns[-1:]).where("hits = 1")
        found = later.join(unique, "target").agg(F.min(F.struct("place", "mask")).alias("first")).first()["first"]
        if found is None:
            break
        places.append(found["place"])
        turns.append(turns[-1] & ~found["mask"])
    free = F.array(*[F.lit(t).cast("long") for t in turns])
    of_turns = near.select("*", F.posexplode(free).alias("turn", "free"))
    turn = F.size(F.filter(F.array(*map(F.lit, places)).cast("array<long>"), lambda p: p < F.col("place")))
    met = sums.withColumn("turn", turn).join(answers(of_turns, turns, "turn"), ["turn", "target"])
    status = F.when(F.col("hits") == 1, "unique").otherwise("ambiguous")
    return met.select("settlement_id", status.alias("status"), F.explode(members(F.array(*map(F.lit, ids)).cast("array<long>"), F.col("mask"))).alias("bank_id"))


@dataclass
class Linked:
    groups: DataFrame  # pending_id (chain), pass, bank_id (null where no bank leg was attached)
    ambiguous: DataFrame  # pass, pending_id, bank_id; from link(): made where it is read, since alike chains and credits multiply
    unmatched_banks: DataFrame  # bank_id
    torn: DataFrame | None = None  # pass, pending_id, first (named, key, amount) of its candidates


def link(pending: DataFrame, banks: DataFrame, tolerance: Tolerance = Tolerance()) -> Linked:
    """P1, P2 and P3 in turn over what is left; each chain ends in one group, each credit in one or in none."""
    banks = _named(banks)
    p1 = attach_alike(pending, banks, exact_pairs)
    left, free = p1.pending.checkpoint(), p1.banks.checkpoint()
    sums = decided_sums(settlements(left), free)
    own, several, p2 = left.select("pending_id", "settlement_id"), sums.torn, sums.unique.select("settlement_id", "bank_id")
    ids, done, torn = p2.select("bank_id"), p2.select("settlement_id").unionByName(several.select("settlement_id")), several.select("settlement_id", "first")
    tied = several.select("settlement_id", "target").join(free.select("bank_id", F.col("amount").alias("target")), "target").select("settlement_id", "bank_id")
    if sums.turned is not None:
        turned = sums.turned.checkpoint()
        few = turned.where("status = 'ambiguous'").select("settlement_id", "bank_id")
        first = F.min(F.struct("named", record_key("bank", "bank_id").alias("key"), "amount")).alias("first")
        torn = torn.unionByName(few.join(free, "bank_id").groupBy("settlement_id").agg(first))
        tied, p2 = tied.unionByName(few), p2.unionByName(turned.where("status = 'unique'").select("settlement_id", "bank_id"))
        ids, done = ids.unionByName(turned.select("bank_id")), done.unionByName(turned.select("settlement_id"))
    left = left.join(done, "settlement_id", "left_anti")
    free = free.join(ids, "bank_id", "left_anti").join(several.select(F.col("target").alias("amount")), "amount", "left_anti")
    p3 = attach_alike(left, free, partial(band_pairs, tolerance=tolerance))

    def of(name: str, rows: DataFrame, last: str = "bank_id") -> DataFrame:
        return rows.select("pending_id", F.lit(name).alias("pass"), last)

    ambiguous = reduce(DataFrame.unionByName, [of("P1", p1.tied), of("P2", own.join(tied, "settlement_id")), of("P3", p3.tied)])
    claimed = reduce(DataFrame.unionByName, [of("P1", p1.claimed), of("P2", own.join(p2, "settlement_id")), of("P3", p3.claimed)])
    firsts = reduce(DataFrame.unionByName, [of("P1", p1.torn, "first"), of("P2", own.join(torn, "settlement_id"), "first"), of("P3", p3.torn, "first")])
    rest = pending.join(claimed, "pending_id", "left_anti").select("pending_id", F.lit("P0").alias("pass"), F.lit(None).cast("long").alias("bank_id"))
    return Linked(claimed.unionByName(rest), ambiguous, banks.join(claimed, "bank_id", "left_anti").select("bank_id"), firsts)


def numbered_groups(routed: DataFrame, linked: Linked) -> DataFrame:
    """match_id, rule, pass, confidence_bps, component: groups of P0 first, then what each pass claimed, leftovers last.

    Ids count from 1 in that order, and by the smallest order within a pass; a settlement that P2 claims is one
    group for each of its chains.
    """
    first = routed.where("kind = 'group'").select("component", F.lit("P0").alias("pass"), F.lit(0).alias("phase"))
    place = F.when(F.col("pass") == "P0", 4).otherwise(F.substr("pass", F.lit(2)).cast("int"))
    later = linked.groups.select(F.col("pending_id").alias("component"), "pass", place.alias("phase"))
    rows = numbered(first.unionByName(later.distinct()), "phase", "component")
    rule, sure = (F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for m in (RULE, CONFIDENCE))
    return rows.select(record_key("match", "line_no").alias("match_id"), rule[F.col("pass")].alias("rule"), "pass", sure[F.col("pass")].alias("confidence_bps"), "component")


def contested(candidates: Column) -> Column:
    """Of arrays of keys: the smallest key that is in some but not in all; with one candidate its first."""
    union = F.array_distinct(F.flatten(candidates))
    every = F.aggregate(candidates, F.get(candidates, F.lit(0)), lambda acc, x: F.array_intersect(acc, x))
    return F.coalesce(F.array_min(F.array_except(union, every)), F.get(F.get(candidates, F.lit(0)), F.lit(0)))
