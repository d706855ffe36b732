"""Evidence: seven lookups for many calls at once, as one join of the distinct calls with what can be looked up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assure.functions.text import record_key
from assure.sources.shared import written

# The tools and their arguments. All are needed, but for the last tool's, of which one is.
ARGUMENTS = {
    "fetch_payment": ("payment_id",), "fetch_transfer": ("transfer_id",), "fetch_dispute": ("dispute_id",), "fetch_refunds_for_payment": ("payment_id",),
    "fetch_settlement_recon": ("date",), "fetch_rate_card": ("as_of", "seller_id"), "search_intent_ledger": ("order_id", "seller_id"),
}
#: Tools that give one record: none is a failure.
SINGLE = ("fetch_payment", "fetch_transfer", "fetch_dispute")
SEARCH = "search_intent_ledger"


class Evidence:
    """What can be looked up in a run's canonical tables: tool, arg, ref, role, body and what else a call tests.

    Rows are made for the kinds of lookup that calls ask for, when they first do, and written once; a call meets those of its kind.
    A row without ref says that the argument is known though nothing may hang on it. An answer is held by its call: refs are joined
    when they are needed, and answers are counted and digested per distinct call, so a day or a seller with many rows that many
    exceptions ask for is read once.
    """

    def __init__(self, records):
        t = records.table
        pay, trf, order = (record_key(p, n) for p, n in (("pay", "payment_id"), ("trf", "transfer_id"), ("ord", "k")))
        seller = record_key("sell", "seller")
        card = F.concat(record_key("card", "seller"), F.lit("/"), F.coalesce("category", F.lit("")), F.lit("/"), F.coalesce(F.col("ver").cast("string"), F.lit("")))
        intents = t("intent").where("k IS NOT NULL")
        self.spark = intents.sparkSession
        self._kinds = {
            "fetch_payment": (self._rows(t("payment"), "fetch_payment", pay, pay, "payment"),), "fetch_transfer": (self._rows(t("transfer"), "fetch_transfer", trf, trf, "transfer"),),
            "fetch_dispute": (self._rows(t("dispute"), "fetch_dispute", record_key("disp", "dispute_id"), record_key("disp", "dispute_id"), "dispute"),),
            "fetch_refunds_for_payment": (
                self._rows(t("payment"), "fetch_refunds_for_payment", pay, None, ""), self._rows(t("refund"), "fetch_refunds_for_payment", pay, record_key("rfnd", "refund_id"), "refund"),
            ),
            "fetch_settlement_recon": (self._rows(t("recon"), "fetch_settlement_recon", F.col("settled").cast("string"), record_key("rcn", "recon_id"), "settlement_recon"),),
            "fetch_rate_card": (
                self._rows(t("rate_card").select("seller").distinct(), "fetch_rate_card", seller, None, ""),
                self._rows(t("rate_card"), "fetch_rate_card", seller, card, "rate_card", eff_from=F.col("eff_from"), eff_to=F.col("eff_to")),
            ),
            f"{SEARCH} order": (self._rows(intents, SEARCH, F.concat(F.lit("order "), order), record_key("int", "k"), "intent", seller=seller),),
            f"{SEARCH} seller": (self._rows(intents, SEARCH, F.concat(F.lit("seller "), seller), record_key("int", "k"), "intent", seller=seller),),
        }
        self._made: dict[str, DataFrame] = {}

    def rows_for(self, calls: DataFrame) -> DataFrame | None:
        """What the calls (tool, arg) can meet: the rows of their kinds of lookup, which are few names; None if there are none."""
        kind = F.when(F.col("tool") == SEARCH, F.concat("tool", F.lit(" "), F.substring_index("arg", " ", 1))).otherwise(F.col("tool"))
        asked = sorted({r["kind"] for r in calls.select(kind.alias("kind")).where(F.col("kind").isin(*self._kinds)).distinct().collect()})  # a row a kind at most
        for k in asked:
            if k not in self._made:
                self._made[k] = written(reduce(DataFrame.unionByName, self._kinds[k]).where("arg IS NOT NULL"))
        return reduce(DataFrame.unionByName, [self._made[k] for k in asked]) if asked else None

    @staticmethod
    def _rows(df: DataFrame, tool: str, arg: Column, ref: Column | None, role: str, **more: Column) -> DataFrame:
        kinds = {"seller": "string", "eff_from": "date", "eff_to": "date"}
        body = F.xxhash64(*[F.col(f.name) for f in df.schema if f.dataType.typeName() not in ("map", "variant")])
        extra = [more.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]
        return df.select(F.lit(tool).alias("tool"), arg.alias("arg"), (F.lit(None).cast("string") if ref is None else ref).alias("ref"), F.lit(role).alias("role"), body.alias("body"), *extra)

    def met(self, calls: DataFrame) -> DataFrame:
        """The distinct calls (tool, arg, of_seller, as_of) with each row that answers them."""
        rows = self.rows_for(calls)
        if rows is None:
            return calls.limit(0).select(*CALL, F.lit(None).cast("string").alias("ref"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("long").alias("body"))
        c, x = calls.alias("c"), rows.alias("x")
        on = (F.col("c.tool") == F.col("x.tool")) & (F.col("c.arg") == F.col("x.arg"))
        fits = F.when((F.col("c.tool") == "fetch_rate_card") & F.col("x.ref").isNotNull(), F.col("c.as_of").between(F.col("x.eff_from"), F.coalesce("x.eff_to", "c.as_of"))).otherwise(
            F.col("c.of_seller").isNull() | (F.col("c.of_seller") == F.col("x.seller"))
        )
        return c.join(x, on).where(F.coalesce(fits, F.lit(False))).select(*[f"c.{n}" for n in CALL], "x.ref", "x.role", "x.body")

    def answers(self, calls: DataFrame) -> DataFrame:
        """calls (tool, args: a map, and columns of their own) with error (null: none), n_rows and digest of each answer.

        Nothing that a call holds raises: an unknown tool, missing or further arguments and records that do not exist are errors of
        that call. Null arguments count as not given. The digest does not depend on the order of rows.
        """
        asked = parsed(calls)
        found = self.met(asked.where("error IS NULL").select(*CALL).distinct()).groupBy(*CALL).agg(
            F.count("ref").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("ref").isNotNull(), F.col("body")).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("_sum")
        )
        a, f = asked.alias("a"), found.alias("f")
        same = [F.col(f"a.{n}").eqNullSafe(F.col(f"f.{n}")) for n in CALL[2:]]
        rows = a.join(f, reduce(lambda x, y: x & y, same, (F.col("a.tool") == F.col("f.tool")) & (F.col("a.arg") == F.col("f.arg"))), "left")
        needs_subject = F.col("a.tool").isin(*SINGLE, "fetch_refunds_for_payment", "fetch_rate_card")
        error = F.coalesce("a.error", F.when(needs_subject & F.col("f.n_rows").isNull(), F.concat(F.lit("no record "), F.col("a.arg"))))
        n = F.when(error.isNull(), F.coalesce("f.n_rows", F.lit(0))).otherwise(0)
        digest = F.sha2(F.concat_ws(":", F.coalesce(error, F.lit("")), n.cast("string"), F.coalesce("f._sum", F.lit("0"))), 256)
        return rows.select(*[F.col(f"a.{x}") for x in asked.columns if x != "error"], error.alias("error"), n.cast("long").alias("n_rows"), digest.alias("digest"))

    def refs(self, answered: DataFrame, *by: str) -> DataFrame:
        """by, ref, role, first (turn, pos) of each distinct record that the answered calls without error gave."""
        good = answered.where("error IS NULL")
        a, m = good.alias("a"), self.met(good.select(*CALL).distinct()).where("ref IS NOT NULL").alias("m")
        on = reduce(lambda x, y: x & y, [F.col(f"a.{n}").eqNullSafe(F.col(f"m.{n}")) for n in CALL[2:]], (F.col("a.tool") == F.col("m.tool")) & (F.col("a.arg") == F.col("m.arg")))
        return a.join(m, on).groupBy(*[F.col(f"a.{n}") for n in by], "m.ref", "m.role").agg(F.min(F.struct("a.turn", "a.pos")).alias("first"))

    def gathered(self, answered: DataFrame, by: str) -> DataFrame:
        """by, evidence: how many distinct records its calls gave. Only where one tool was asked twice are records met and told apart."""
        good = answered.where("error IS NULL").groupBy(by, *CALL).agg(F.max("n_rows").alias("n_rows"))
        per_tool = good.groupBy(by, "tool").agg(F.count("*").alias("asked"), F.sum("n_rows").alias("n"))
        again = per_tool.where("asked > 1").select(by, "tool")
        single = per_tool.where("asked = 1").select(by, "n")
        met = good.join(again, [by, "tool"], "left_semi").withColumns({"error": F.lit(None).cast("string"), "turn": F.lit(0), "pos": F.lit(0)})
        several = self.refs(met, by).groupBy(by).agg(F.count("*").alias("n"))
        return single.unionByName(several).groupBy(by).agg(F.sum("n").cast("long").alias("evidence"))


#: What makes a call: equal ones have equal answers.
CALL = ("tool", "arg", "of_seller", "as_of")


def parsed(calls: DataFrame) -> DataFrame:
    """calls with arg, of_seller, as_of and error (null: a call that can be made)."""
    args = F.coalesce(F.map_filter("args", lambda _, v: v.isNotNull()), F.create_map().cast("map<string,string>"))
    given = F.array_sort(F.map_keys(args))
    names = F.create_map(*[x for t, ns in ARGUMENTS.items() for x in (F.lit(t), F.array(*[F.lit(n) for n in sorted(ns)]))])[F.col("tool")]
    search = F.col("tool") == SEARCH
    error = (
        F.when(F.coalesce(~F.col("tool").isin(*ARGUMENTS), F.lit(True)), "unknown tool")
        .when(F.size(F.array_except(given, names)) > 0, "bad arguments")
        .when(search & (F.size(given) == 0), "order_id or seller_id is needed")
        .when(~search & (F.size(given) < F.size(names)), "bad arguments")
    )
    order, seller = args["order_id"], args["seller_id"]
    arg = F.when(search, F.coalesce(F.concat(F.lit("order "), order), F.concat(F.lit("seller "), seller))).otherwise(
        F.coalesce(*[args[n] for n in ("payment_id", "transfer_id", "dispute_id", "date", "seller_id")])
    )
    return calls.withColumns({"arg": arg, "of_seller": F.when(search & order.isNotNull(), seller), "as_of": F.when(F.col("tool") == "fetch_rate_card", F.try_to_date(args["as_of"])), "error": error})
