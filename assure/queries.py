"""The catalogue: a query for each operator, over the driver's tables as settlement records, and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assure import oracles as O
from assure.functions import dates, money, text
from assure.operators import checks, constraints, linking, subsets, triage, units
from assure.operators.components import components
from assure.plans import close, score, synth
from assure.plans.projection import AS_OF, TABLES, Records
from assure.sources import normalise
from assure.sources.shared import checkpoint_dir, small_tasks, stamp, written


class Run:
    """The stages of one run over a folder of driver tables, each made on first use and written to the shared folder."""

    _open: dict[tuple, Run] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Run:
        """The run of a folder: the one that is open in this application, as long as the folder's files are the same."""
        own = (spark.sparkContext.applicationId, checkpoint_dir(spark), sf_dir)
        try:
            files = tuple(stamp(spark, f"{sf_dir}/{t}.parquet") for t in TABLES)
        except Py4JJavaError:  # storage that can't be listed: nothing tells whether its files are the same
            return cls(spark, sf_dir)
        found = cls._open.get(own)
        if found is None or found.files != files or found.spark is not spark:
            found = cls._open[own] = cls(spark, sf_dir)
            found.files = files
        return found

    def __init__(self, spark: SparkSession, sf_dir: str):
        checkpoint_dir(spark)
        small_tasks(spark, [f"{sf_dir}/{t}.parquet" for t in TABLES])
        self.spark, self.sf_dir = spark, sf_dir
        self.records = Records(spark, sf_dir)
        self.specs = checks.checks(AS_OF)

    def t(self, name: str) -> DataFrame:
        return self.records.table(name)

    @property
    def placed_payment(self) -> DataFrame:
        """Payments with the order they belong to."""
        return self.t("payment")

    @property
    def placed_recon(self) -> DataFrame:
        """Settlement rows whose transfer_id is the key of their order, as it is in these tables."""
        return self.t("recon")

    @property
    def bank_named(self) -> Column:
        """By what the first of tied credits is chosen, of columns of bank: its key as text."""
        return text.record_key("bank", "bank_id")

    @cached_property
    def chains(self) -> DataFrame:
        """node, component: orders by key, banks from BANK_NODE on, so that a chain's smallest order names it."""
        return written(components(linking.join_edges(self.t("intent"), self.placed_recon, self.t("bank"), O.BANK_NODE)))

    @cached_property
    def routed(self) -> DataFrame:
        def side(df: DataFrame, node: Column, name: str, place: int, **own: str) -> DataFrame:
            kinds = {"credit": "long", "debit": "long", "settlement_id": "long", "settled": "date"}
            more = [(F.col(own[c]) if c in own else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()]
            return df.select(node.alias("node"), (node * 4 + place).alias("ord"), F.lit(name).alias("side"), *more)

        recon = {"credit": "credit", "debit": "debit", "settlement_id": "settlement_id", "settled": "settled"}
        members = (
            side(self.t("intent"), F.col("k"), "intent", 0)
            .unionByName(side(self.placed_payment, F.col("order_id"), "razorpay", 1))
            .unionByName(side(self.placed_recon, F.col("transfer_id"), "razorpay", 2, **recon))
            .unionByName(side(self.t("bank"), F.col("bank_id") + F.lit(O.BANK_NODE), "bank", 3))
        )
        return written(linking.route(members.join(self.chains, "node")))

    @cached_property
    def pending(self) -> DataFrame:
        return self.routed.where("kind = 'pending'").select(F.col("component").alias("pending_id"), "target_paise", "settlement_id", "settled")

    @cached_property
    def orphans(self) -> DataFrame:
        alone = self.chains.where(F.col("component") >= O.BANK_NODE).select((F.col("component") - F.lit(O.BANK_NODE)).alias("bank_id"))
        return self.t("bank").join(alone, "bank_id").select("bank_id", "amount", "credited", self.bank_named.alias("named"))

    @cached_property
    def linked(self) -> linking.Linked:
        made = linking.link(self.pending, self.orphans)
        return linking.Linked(written(made.groups), made.ambiguous, written(made.unmatched_banks), written(made.torn))

    @cached_property
    def groups(self) -> DataFrame:
        """The numbered groups of all passes."""
        return written(linking.numbered_groups(self.routed, self.linked))

    @cached_property
    def banked(self) -> DataFrame:
        with_bank = self.chains.where(F.col("node") >= O.BANK_NODE).select("component").unionByName(
            self.linked.groups.where("bank_id is not null").select(F.col("pending_id").alias("component"))
        )
        orders = self.chains.where(F.col("node") < O.BANK_NODE).join(with_bank.distinct(), "component", "left_semi")
        return orders.select(F.col("node").alias("k")).join(self.placed_recon.select(F.col("transfer_id").alias("k")), "k", "left_semi")

    @cached_property
    def units(self) -> DataFrame:
        return written(checks.amounts(units.units(self.records, AS_OF, self.banked), AS_OF))

    @cached_property
    def findings(self) -> DataFrame:
        """Written once: the queue, its evidence and its reports read them, several times each."""
        return written(checks.findings(self.units, self.specs))

    @cached_property
    def queue(self) -> DataFrame:
        bank = self.t("bank").select("bank_id", "amount", self.bank_named.alias("named"))
        loose = self.linked.unmatched_banks.join(bank, "bank_id").select(text.record_key("bank", "bank_id").alias("key"), "amount", F.lit("residual: unmatched record").alias("reason"))
        torn = self.linked.torn
        if torn is None:
            tied = self.linked.ambiguous.join(bank, "bank_id").withColumn("key", text.record_key("bank", "bank_id"))
            torn = tied.groupBy("pass", "pending_id").agg(F.min(F.struct("named", "key", "amount")).alias("first"))
        torn = torn.select("first.key", "first.amount", F.concat(F.lit("ambiguous in "), "pass").alias("reason"))
        found = self.findings.select(F.concat("defect", F.lit("/"), text.record_key("ord", "k")).alias("key"), "amount", F.col("defect").alias("reason"))
        return written(triage.queue(loose, torn, found))

    @cached_property
    def raw_intent(self) -> DataFrame:
        """The ledger as its file would have it: all text, some rows malformed."""
        i = self.t("intent")

        def rupees(c: str) -> Column:
            n = F.col(c)
            return F.concat(money.div(n, 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))

        gross = F.when(F.col("k") % 83 == 0, F.lit("abc")).otherwise(rupees("gross"))
        placed = F.when(F.col("k") % 79 == 0, F.lit("2026-13-01 00:00:00")).otherwise(F.concat(F.col("placed").cast("string"), F.lit(" 01:30:00")))
        return i.select(
            "k", F.concat(F.lit("Seller "), (F.col("seller") - F.when(F.col("seller") == 7, 1).otherwise(0)).cast("string")).alias("seller_name"), gross.alias("gross_amount"), placed.alias("placed_at_ist"),
            F.when(F.col("k") % 2 == 0, "Y").otherwise("N").alias("is_interstate"), rupees("commission").alias("expected_commission"), F.col("applied_bps").cast("string").alias("commission_rate_bps"),
            rupees("tcs").alias("expected_tcs"), rupees("tds").alias("expected_tds"),
        )

    @cached_property
    def normal(self) -> DataFrame:
        return normalise.normalised(self.raw_intent, normalise.intent_fields(), "intent")

    @cached_property
    def sellers(self) -> DataFrame:
        """seller_id, seller_name; two sellers go by one name."""
        rows = self.t("pairs").select("seller").distinct()
        shown = F.col("seller") - F.when(F.col("seller") == 7, 1).otherwise(0)
        return rows.select(text.record_key("sel", "seller").alias("seller_id"), F.concat(F.lit("Seller "), shown.cast("string")).alias("seller_name"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a Run under its name, with its SQL."""

    def add(f: Callable[[Run], DataFrame]) -> Callable[[Run], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Run.of(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def long(*columns: str) -> list[Column]:
    return [F.col(c).cast("long").alias(c) for c in columns]


# functions


@query(f"{O.D} SELECT k, {O.b('gross - 15000000', 'applied_bps')} AS share, {O.b('gross', 7)} AS small FROM intent")
def f_apply_bps(r: Run) -> DataFrame:
    return r.t("intent").select("k", money.apply_bps(F.col("gross") - 15000000, "applied_bps").alias("share"), money.apply_bps("gross", F.lit(7)).alias("small"))


@query(f"""{O.D} SELECT k, CASE WHEN k % 83 = 0 THEN NULL ELSE gross END AS paise, CASE WHEN k % 10 = 0 THEN -(k % 50) * 100 + 50 ELSE (k % 50) * 100 + 50 END AS signed_paise FROM intent""")
def f_rupee_parse(r: Run) -> DataFrame:
    t = F.concat(F.when(F.col("k") % 10 == 0, "-").otherwise(""), (F.col("k") % 50).cast("string"), F.lit(".5"))
    return r.raw_intent.select("k", money.paise_of_rupees("gross_amount").alias("paise"), money.paise_of_rupees(t).alias("signed_paise"))


@query(f"""{O.D} SELECT k, CASE WHEN k % 79 = 0 THEN NULL ELSE strftime(CAST(placed AS TIMESTAMP) + INTERVAL '90 minutes' - INTERVAL '330 minutes', '%Y-%m-%dT%H:%M:%SZ') END AS utc FROM intent""")
def f_ist_to_utc(r: Run) -> DataFrame:
    return r.raw_intent.select("k", dates.utc_text(dates.ist_to_utc("placed_at_ist")).alias("utc"))


@query(f"""{O.D} SELECT k, strftime(CAST(placed AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ') AS utc, strftime(placed, '%Y-%m') AS period FROM intent""")
def f_epoch_to_utc(r: Run) -> DataFrame:
    at = dates.epoch_to_utc(F.unix_date("placed").cast("long") * 86400)
    return r.t("intent").select("k", dates.utc_text(at).alias("utc"), dates.period(at).alias("period"))


@query(f"{O.D} {O.EXTRACT}")
def f_extract_utr(r: Run) -> DataFrame:
    rows = r.t("narration").select("bank_id", text.extract_utr("narration").alias("u"))
    return rows.select("bank_id", "u.utr", F.col("u.confidence_bps").cast("long").alias("confidence_bps"), "u.pattern")


@query(f"""{O.D} SELECT r.recon_id, GREATEST(100, {O.b("ABS(credit - debit)", 10)}) AS band, ABS(credit - debit - amount) <= GREATEST(100, {O.b("ABS(credit - debit)", 10)}) AS inside, ABS(settled - credited) <= 2 AS near FROM recon r JOIN bank ON bank_id = recon_id""")
def f_band_within(r: Run) -> DataFrame:
    band, met = money.Tolerance(), r.t("recon").join(r.t("bank").select(F.col("bank_id").alias("recon_id"), "amount", "credited"), "recon_id")
    net = F.col("credit") - F.col("debit")
    return met.select("recon_id", band.band(net).alias("band"), band.within(net, "amount").alias("inside"), dates.within_days("settled", "credited", 2).alias("near"))


@query(f"{O.D} SELECT k, CASE WHEN tcs >= 100000 THEN 'high' WHEN tcs >= 10000 THEN 'medium' ELSE 'low' END AS severity, {O.record_key('ord', 'k')} AS key FROM intent")
def f_severity(r: Run) -> DataFrame:
    return r.t("intent").select("k", money.severity("tcs").alias("severity"), text.record_key("ord", "k").alias("key"))


# ingest


@query(f"""{O.D} SELECT k, CASE WHEN k % 83 = 0 OR k % 79 = 0 THEN 'normalise_failed' END AS reason,
  CASE WHEN k % 83 = 0 THEN 'malformed intent row: gross_amount' WHEN k % 79 = 0 THEN 'malformed intent row: placed_at_ist' END AS detail,
  CASE WHEN k % 83 = 0 OR k % 79 = 0 THEN NULL ELSE gross END AS gross_paise, CASE WHEN k % 83 = 0 OR k % 79 = 0 THEN NULL ELSE k % 2 = 0 END AS is_interstate FROM intent""")
def ingest_quarantine_split(r: Run) -> DataFrame:
    """All rows in one pass, told apart by their reason: both parts of split() would parse each row again."""
    return r.normal.select("k", F.col("quarantine_reason").alias("reason"), F.col("quarantine_detail").alias("detail"), "gross_paise", "is_interstate")


def _rupees(c: str) -> str:
    return f"CAST({c} // 100 AS VARCHAR) || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0')"


@query(f"""{O.D}, s AS (SELECT *, CASE WHEN k % 83 = 0 THEN 0 WHEN k % 79 = 0 THEN 1 ELSE 7 END AS reached FROM intent)
SELECT k, 1 AS step, 'gross_paise' AS field, {_rupees("gross")} AS before_text, CAST(gross AS VARCHAR) AS after_text FROM s WHERE reached >= 1
UNION ALL SELECT k, 2, 'placed_at_utc', CAST(placed AS VARCHAR) || ' 01:30:00', strftime(CAST(placed AS TIMESTAMP) + INTERVAL '90 minutes' - INTERVAL '330 minutes', '%Y-%m-%dT%H:%M:%SZ') FROM s WHERE reached >= 2
UNION ALL SELECT k, 3, 'is_interstate', CASE WHEN k % 2 = 0 THEN 'Y' ELSE 'N' END, CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END FROM s WHERE reached >= 3
UNION ALL SELECT k, 4, 'commission_paise', {_rupees("commission")}, CAST(commission AS VARCHAR) FROM s WHERE reached >= 4
UNION ALL SELECT k, 5, 'commission_rate_applied_bps', CAST(applied_bps AS VARCHAR), CAST(applied_bps AS VARCHAR) FROM s WHERE reached >= 5
UNION ALL SELECT k, 6, 'expected_tcs_paise', {_rupees("tcs")}, CAST(tcs AS VARCHAR) FROM s WHERE reached >= 6
UNION ALL SELECT k, 7, 'expected_tds_paise', {_rupees("tds")}, CAST(tds AS VARCHAR) FROM s WHERE reached >= 7""")
def ingest_transform_lineage(r: Run) -> DataFrame:
    return normalise.lineage(r.raw_intent, normalise.intent_fields(), "k").select("k", *long("step"), "field", "before_text", "after_text")


@query(f"""{O.D}, sel AS (SELECT {O.record_key("sel", "seller")} AS id, 'Seller ' || CAST(seller - CASE WHEN seller = 7 THEN 1 ELSE 0 END AS VARCHAR) AS name FROM (SELECT DISTINCT seller FROM pairs)),
n AS (SELECT name, COUNT(*) AS c, MIN(id) AS id FROM sel GROUP BY name), i AS (SELECT k, 'Seller ' || CAST(seller - CASE WHEN seller = 7 THEN 1 ELSE 0 END AS VARCHAR) AS name FROM intent)
SELECT k, CASE WHEN c = 1 THEN id ELSE i.name END AS seller_id, CASE WHEN c = 1 THEN 'seller_name_resolved' WHEN c > 1 THEN 'seller_name_ambiguous' ELSE 'seller_name_not_found' END AS resolution FROM i LEFT JOIN n ON n.name = i.name""")
def ingest_seller_resolution(r: Run) -> DataFrame:
    return normalise.resolved_sellers(r.raw_intent.select("k", "seller_name"), r.sellers).select("k", "seller_id", "resolution")


@query(f"""{O.D} SELECT 'intent' AS source, COUNT(*) AS total, COUNT(*) FILTER (k % 83 <> 0 AND k % 79 <> 0) AS normalised, COUNT(*) FILTER (k % 83 = 0 OR k % 79 = 0) AS quarantined FROM intent""")
def ingest_counts(r: Run) -> DataFrame:
    return normalise.counts(r.normal, "intent")


# rates and units


@query(f"""{O.D} SELECT k, CASE WHEN placed >= DATE '2024-10-01' THEN 10 END AS tds, CASE WHEN placed >= DATE '2024-07-10' THEN 50 END AS tcs, 1800 AS gst FROM intent""")
def rate_asof_statutory(r: Run) -> DataFrame:
    return r.t("intent").select("k", *[units.statutory(kind, F.col("placed")).cast("long").alias(name) for kind, name in (("TDS", "tds"), ("TCS", "tcs"), ("GST_ON_FEES", "gst"))])


@query(f"""{O.D} SELECT k, bps AS card_bps FROM intent i LEFT JOIN rate_card c ON c.seller = i.seller AND c.category = i.category AND i.placed >= c.eff_from AND (c.eff_to IS NULL OR i.placed <= c.eff_to)""")
def rate_asof_seller_card(r: Run) -> DataFrame:
    return units.seller_card(r.t("intent"), r.t("rate_card")).select("k", *long("card_bps"))


@query(f"{O.UNITS} SELECT completeness, COUNT(*) AS n, CAST(SUM(gross) AS BIGINT) AS gross FROM u GROUP BY completeness")
def units_completeness(r: Run) -> DataFrame:
    return r.units.groupBy("completeness").agg(F.count("*").alias("n"), money.sum_paise("gross").alias("gross"))


@query(f"{O.UNITS} SELECT k, n_payments, fee, tax, fee_gst, n_refunds, refunds, disputes, orphaned, reversals, n_recons, credit, debit, completeness FROM u")
def units_preagg(r: Run) -> DataFrame:
    return r.units.select("k", *long("n_payments", "fee", "tax", "fee_gst", "n_refunds", "refunds", "disputes", "orphaned", "reversals", "n_recons", "credit", "debit"), "completeness")


# matching


@query(f"""{O.D}, rc AS (SELECT utr, MIN(transfer_id) AS c FROM recon GROUP BY utr), o AS (SELECT i.k AS node, COALESCE(rc.c, i.k) AS component FROM intent i LEFT JOIN recon r ON r.transfer_id = i.k LEFT JOIN rc ON rc.utr = r.utr)
SELECT node, component FROM o UNION ALL SELECT {O.BANK_NODE} + bank_id, COALESCE(rc.c, {O.BANK_NODE} + (SELECT MIN(x.bank_id) FROM bank x WHERE x.bank_id = b.bank_id)) FROM bank b LEFT JOIN rc ON rc.utr = b.utr""")
def match_p0_components(r: Run) -> DataFrame:
    return r.chains.select("node", "component")


@query(f"""{O.LINK}, o AS (SELECT i.k, COALESCE(rc.pending_id, i.k) AS c, i.has_lines, rc.utr, rc.pending_id FROM intent i LEFT JOIN recon r ON r.transfer_id = i.k LEFT JOIN rc ON rc.utr = r.utr),
k AS (SELECT c, BOOL_OR(has_lines) AS paid, MAX(utr) AS utr FROM o GROUP BY c), x AS (SELECT CASE WHEN utr IS NOT NULL AND utr NOT IN (SELECT utr FROM bank WHERE utr IS NOT NULL) THEN 'pending' WHEN paid THEN 'group' ELSE 'remaining' END AS kind, c AS component FROM k
UNION ALL SELECT 'remaining', {O.BANK_NODE} + bank_id FROM orph)
SELECT component, kind, COALESCE(rc.target_paise, 0) AS target_paise FROM x LEFT JOIN rc ON rc.pending_id = x.component""")
def match_p0_routing(r: Run) -> DataFrame:
    return r.routed.select("component", "kind", "target_paise")


@query(f"{O.LINK} SELECT pending_id, bank_id, dp = 1 AND db = 1 AS claimed FROM p1p")
def match_p1_exact(r: Run) -> DataFrame:
    a = linking.attach(r.pending, r.orphans, linking.exact_pairs(r.pending, r.orphans))
    return a.claimed.withColumn("claimed", F.lit(True)).unionByName(a.tied.withColumn("claimed", F.lit(False)))


@query(f"{O.LINK} SELECT settlement_id, status, bank_id FROM p2")
def match_p2_single_sum(r: Run) -> DataFrame:
    a = linking.attach(r.pending, r.orphans, linking.exact_pairs(r.pending, r.orphans))
    return linking.grouped_sums(linking.settlements(a.pending), a.banks)


@query(O.SUBSETS)
def match_p2_subset(r: Run) -> DataFrame:
    """The free credits of each week, against the sum of each two that follow one another in amount."""
    credits = r.orphans.select(F.to_date(F.date_trunc("week", "credited")).alias("week"), "bank_id", "amount")
    after = W.partitionBy("week").orderBy("amount", "bank_id")
    sums = credits.select("week", F.col("bank_id").alias("target_id"), (F.col("amount") + F.lead("amount").over(after)).alias("target"))
    return subsets.subset_matches(credits, written(sums.where("target IS NOT NULL")), "week")


@query(f"{O.LINK} SELECT pending_id, bank_id, dp = 1 AND db = 1 AS claimed FROM p3p")
def match_p3_band(r: Run) -> DataFrame:
    a = linking.attach(r.pending, r.orphans, linking.exact_pairs(r.pending, r.orphans))
    sums = linking.grouped_sums(linking.settlements(a.pending), a.banks).checkpoint()
    left, free = a.pending.join(sums, "settlement_id", "left_anti"), a.banks.join(sums, "bank_id", "left_anti")
    b = linking.attach(left, free, linking.band_pairs(left, free))
    return b.claimed.withColumn("claimed", F.lit(True)).unionByName(b.tied.withColumn("claimed", F.lit(False)))


@query(f"{O.LINK} SELECT bank_id, amount FROM loose")
def match_residual(r: Run) -> DataFrame:
    return r.linked.unmatched_banks.join(r.t("bank").select("bank_id", "amount"), "bank_id")


@query(f"{O.LINK} SELECT (SELECT COUNT(*) FROM pend) AS chains, (SELECT COUNT(*) FROM pend) AS grouped, (SELECT COUNT(*) FROM orph) AS banks, (SELECT COUNT(*) FROM claims) AS claimed, (SELECT COUNT(*) FROM loose) AS loose, CAST(0 AS BIGINT) AS twice")
def match_conservation(r: Run) -> DataFrame:
    groups = r.linked.groups
    twice = groups.where("bank_id is not null").groupBy("bank_id").agg(F.count_distinct("pending_id").alias("n"), F.count_distinct("pass").alias("p")).where("p > 1")
    return close.facts(
        r.pending.agg(F.count("*").alias("chains")), groups.agg(F.count_distinct("pending_id").alias("grouped")), r.orphans.agg(F.count("*").alias("banks")),
        groups.agg(F.count("bank_id").alias("claimed")), r.linked.unmatched_banks.agg(F.count("*").alias("loose")), twice.agg(F.count("*").alias("twice")),
    )


# checks


def _check(defect: str) -> None:
    def run(r: Run) -> DataFrame:
        spec = tuple(s for s in r.specs if s.defect == defect)
        return checks.findings(r.units, spec)

    run.__name__ = f"check_{defect.lower()}"
    query(f"{O.UNITS}, f AS ({O.check(defect)}) SELECT k, defect, amount, {O.SEVERITY} AS severity FROM f")(run)


for _d in O.CHECKS:
    _check(_d)


@query(f"{O.UNITS}, s AS ({O.SKIPS}) SELECT defect, reason, COUNT(*) AS n FROM s GROUP BY defect, reason")
def check_skip_tally(r: Run) -> DataFrame:
    return checks.skip_tally(r.units, r.specs)


@query(f"{O.FOUND} SELECT k, defect, amount, {O.SEVERITY} AS severity FROM f")
def findings_all(r: Run) -> DataFrame:
    return r.findings


_APPLIED, _CARD, _TCS, _TDS = O.b("gross", "applied_bps"), O.b("gross", "card_bps"), O.b("gross - refunds", 50), O.b("gross", 10)
_STEPS = (
    ("D01", 1, "commission applied", _APPLIED), ("D01", 2, "commission on the card", _CARD), ("D01", 3, "drift", f"ABS({_APPLIED} - {_CARD})"),
    ("D02", 1, "expected", "expected"), ("D02", 2, "actual", "credit - debit"), ("D02", 3, "short", "expected - (credit - debit)"), ("D03", 1, "to net", "netting"), ("D03", 2, "not netted", "netting - debit"),
    ("D04", 1, "TCS due", _TCS), ("D04", 2, "difference", f"ABS(tcs - {_TCS})"), ("D05", 1, "TDS due", _TDS), ("D05", 2, "difference", f"ABS(tds - {_TDS})"),
    ("D06", 1, "held", "orphaned"), ("D07", 1, "reversed", "reversals"), ("D08", 1, "GST due", "fee_gst"), ("D08", 2, "difference", "ABS(tax - fee_gst)"),
)


@query(O.FOUND + " UNION ALL ".join(f" SELECT f.k, f.defect, CAST({n} AS BIGINT) AS step_no, '{label}' AS label, CAST({x} AS BIGINT) AS output FROM f JOIN u USING (k) WHERE defect = '{d}'" for d, n, label, x in _STEPS))
def finding_trace_steps(r: Run) -> DataFrame:
    return checks.trace(r.units, r.specs).select("k", "defect", *long("step_no"), "label", "output")


@query(f"""{O.FOUND}, roles AS (SELECT * FROM (VALUES ('D01', 'order'), ('D01', 'intent'), ('D01', 'rate_card'), ('D02', 'order'), ('D02', 'recon_row'), ('D03', 'order'), ('D03', 'refund'), ('D03', 'recon_row'), ('D04', 'order'), ('D04', 'intent'),
  ('D05', 'order'), ('D05', 'intent'), ('D06', 'order'), ('D06', 'transfer'), ('D07', 'order'), ('D07', 'reversal'), ('D08', 'order'), ('D08', 'payment')) t(defect, role)) SELECT k, defect, role FROM f JOIN roles USING (defect)""")
def finding_evidence(r: Run) -> DataFrame:
    return checks.evidence(r.findings, r.specs)


# triage


@query(f"{O.QUEUE} SELECT rank, origin, key, amount, reason FROM queue")
def exception_queue(r: Run) -> DataFrame:
    return r.queue.select("rank", "origin", "key", "amount", "reason")


@query(f"{O.LINK} SELECT pass, pending_id, MIN({O.record_key('bank', 'bank_id')}) AS key FROM tied GROUP BY pass, pending_id")
def contested_key(r: Run) -> DataFrame:
    chain = F.concat(F.lit("zchain_"), F.col("pending_id").cast("string"))
    candidates = r.linked.ambiguous.groupBy("pass", "pending_id").agg(F.collect_list(F.array(text.record_key("bank", "bank_id"), chain)).alias("candidates"))
    return candidates.select("pass", "pending_id", linking.contested(F.col("candidates")).alias("key"))


@query(f"""{O.FOUND}, c AS (SELECT k, defect, amount, CASE WHEN k % 3 = 0 THEN 'ESCALATED_UNRESOLVED' ELSE 'AUTO_RESOLVED' END AS outcome, 8000 + (k % 4) * 500 AS conf FROM f)
SELECT k, defect, CASE WHEN outcome = 'AUTO_RESOLVED' AND (amount >= 10000 OR conf < 9000) THEN 'PROPOSED' ELSE outcome END AS final_outcome,
  CASE WHEN outcome = 'AUTO_RESOLVED' AND amount >= 10000 THEN 'amount' WHEN outcome = 'AUTO_RESOLVED' AND conf < 9000 THEN 'confidence' END AS downgrade_reason FROM c""")
def gate_downgrade(r: Run) -> DataFrame:
    claims = r.findings.withColumn("outcome", F.when(F.col("k") % 3 == 0, "ESCALATED_UNRESOLVED").otherwise("AUTO_RESOLVED")).withColumn("confidence_bps", 8000 + (F.col("k") % 4) * 500)
    return triage.downgraded(claims).select("k", "defect", "final_outcome", "downgrade_reason")


@query(f"{O.FOUND} SELECT DISTINCT 'ord_x' || CAST(k AS VARCHAR) AS key FROM f WHERE k % 50 = 1")
def gate_fabrication(r: Run) -> DataFrame:
    cited = r.findings.select(F.when(F.col("k") % 50 == 1, F.concat(F.lit("ord_x"), F.col("k").cast("string"))).otherwise(text.record_key("ord", "k")).alias("key")).distinct()
    return triage.fabricated(cited, r.t("intent").select(text.record_key("ord", "k").alias("key")))


@query(f"{O.QUEUE} SELECT rank, key, amount, 'ESCALATED_UNRESOLVED' AS outcome, 'rules_only' AS stop_reason FROM queue")
def rules_only_resolutions(r: Run) -> DataFrame:
    return triage.rules_only(r.queue).select("rank", "key", "amount", "outcome", "stop_reason")


@query(f"{O.QUEUE}, s AS (SELECT rank, 50 + amount % 100 AS tokens FROM queue), c AS (SELECT rank, COALESCE(CAST(SUM(tokens) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before FROM s) SELECT rank, before, before < 60000 AS investigated FROM c")
def batch_budget_cutoff(r: Run) -> DataFrame:
    spent = r.queue.select("rank", (F.lit(50) + F.col("amount") % 100).alias("tokens"))
    return triage.within_budget(spent).select("rank", "before", "investigated")


@query(f"""{O.FOUND} SELECT i.k, CASE WHEN MAX(CASE WHEN f.amount >= 100000 THEN 2 WHEN f.amount IS NOT NULL THEN 1 ELSE 0 END) = 2 THEN 'ESCALATED_UNRESOLVED' WHEN COUNT(f.k) > 0 THEN 'PROPOSED' ELSE 'VERIFIED_CLEAN' END AS state FROM intent i LEFT JOIN f USING (k) GROUP BY i.k""")
def terminal_states(r: Run) -> DataFrame:
    outcomes = r.findings.select(F.col("k").alias("key"), F.when(F.col("amount") >= 100_000, "ESCALATED_UNRESOLVED").otherwise("PROPOSED").alias("outcome"))
    return triage.terminal_states(r.t("intent").select(F.col("k").alias("key")), outcomes).withColumnRenamed("key", "k")


@query(f"""{O.D} SELECT i.k, COALESCE(p.n, 0) AS payments, COALESCE(t.n, 0) AS transfers, COALESCE(r.n, 0) AS refunds, COALESCE(d.n, 0) AS disputes, COALESCE(s.n, 0) AS recons FROM intent i
LEFT JOIN (SELECT order_id AS k, COUNT(*) AS n FROM payment GROUP BY 1) p ON p.k = i.k LEFT JOIN (SELECT payment_id AS k, COUNT(*) AS n FROM transfer GROUP BY 1) t ON t.k = i.k
LEFT JOIN (SELECT payment_id AS k, COUNT(*) AS n FROM refund GROUP BY 1) r ON r.k = i.k LEFT JOIN (SELECT payment_id AS k, COUNT(*) AS n FROM dispute GROUP BY 1) d ON d.k = i.k
LEFT JOIN (SELECT transfer_id AS k, COUNT(*) AS n FROM recon GROUP BY 1) s ON s.k = i.k""")
def tool_lookups(r: Run) -> DataFrame:
    return triage.lookups(r.records, r.t("intent"))


# close


_WHERE = "CASE WHEN on_hold AND hold_until IS NULL THEN 'held' WHEN settled IS NOT NULL THEN 'settled' ELSE 'in_flight' END"
_PARTS = f"""w AS (SELECT 'gross' AS measure, SUM(gross) AS paise, 1 AS s FROM intent UNION ALL SELECT 'commission', SUM(commission), -1 FROM intent UNION ALL SELECT 'tcs', SUM(tcs), -1 FROM intent UNION ALL SELECT 'tds', SUM(tds), -1 FROM intent
UNION ALL SELECT 'fees', SUM(fee), -1 FROM payment UNION ALL SELECT 'gst', SUM(tax), -1 FROM payment UNION ALL SELECT 'refunds', SUM(amount), -1 FROM refund UNION ALL SELECT 'reversals', SUM(amount), -1 FROM reversal UNION ALL SELECT 'disputes', SUM(deducted), -1 FROM dispute
UNION ALL SELECT {_WHERE}, SUM(amount), 0 FROM transfer GROUP BY 1)"""


@query(f"{O.D}, {_PARTS} SELECT measure, CAST(COALESCE(paise, 0) AS BIGINT) AS paise FROM w UNION ALL SELECT 'expected_settleable', CAST(SUM(paise * s) AS BIGINT) FROM w")
def close_waterfall(r: Run) -> DataFrame:
    return close.waterfall(r.records).select("measure", "paise")


@query(f"{O.D} SELECT COUNT(*) AS n, CAST(COALESCE(SUM(amount), 0) AS BIGINT) AS paise, CAST(MAX(DATE '{AS_OF}' - placed) AS BIGINT) AS max_age_days FROM transfer JOIN intent ON k = payment_id WHERE on_hold AND hold_until IS NULL")
def close_held_age(r: Run) -> DataFrame:
    return close.held_age(r.records, AS_OF)


@query(f"{O.QUEUE} SELECT COUNT(*) AS escalated, CAST(SUM(amount) AS BIGINT) AS escalated_paise, CAST(SUM(amount) AS DOUBLE) / CAST((SELECT SUM(gross) FROM intent) AS DOUBLE) AS share FROM queue")
def exceptions_header(r: Run) -> DataFrame:
    return close.exceptions_header(triage.rules_only(r.queue), r.t("intent"))


# scoring: injected defects are the moduli of the projection; truth is that each order stands alone

_TRUTH = """truth AS (SELECT k AS o, k % 6 <> 0 AS resolvable FROM intent WHERE has_lines), injected AS (SELECT 'i' || CAST(k AS VARCHAR) AS instance, k AS o, 'D01' AS defect, 1000 AS paise FROM intent WHERE has_lines AND k % 37 = 0
  UNION ALL SELECT 'j' || CAST(k AS VARCHAR), k, 'D05', 500 FROM intent WHERE has_lines AND k % 59 = 0)"""
_SCORED = f"""{O.FOUND}, {_TRUTH}, m AS (SELECT c.pending_id AS match_id, c.pending_id AS o, COUNT(*) OVER (PARTITION BY c.pending_id) AS legs, EXISTS (SELECT 1 FROM f WHERE f.k = c.pending_id) AS flagged, c.bank_id FROM claims c),
sm AS (SELECT match_id, bank_id = o AS right_one, bank_id <> o AND NOT flagged AS silent FROM m),
sd AS (SELECT i.instance, i.o, i.defect, i.paise, MAX(CASE WHEN f.k IS NOT NULL THEN 1 ELSE 0 END) = 1 AS detected, MAX(CASE WHEN f.defect = i.defect THEN 1 ELSE 0 END) = 1 AS same FROM injected i LEFT JOIN f ON f.k = i.o GROUP BY 1, 2, 3, 4),
sa AS (SELECT o, CASE WHEN resolvable THEN 'OVER' ELSE 'CORRECT' END AS verdict FROM truth WHERE o IN (SELECT k FROM f))"""


def _truth(r: Run) -> tuple[DataFrame, DataFrame]:
    paid = r.t("intent").where("has_lines")
    truth = paid.select(F.col("k").alias("order"), (F.col("k") % 6 != 0).alias("resolvable"))
    one = lambda p, m, d, n: paid.where(F.col("k") % m == 0).select(F.concat(F.lit(p), F.col("k").cast("string")).alias("instance"), F.col("k").alias("order"), F.lit(d).alias("defect"), F.lit(n).cast("long").alias("paise"))
    return truth, one("i", 37, "D01", 1000).unionByName(one("j", 59, "D05", 500))


def _matches(r: Run) -> DataFrame:
    claims = r.linked.groups.where("bank_id is not null").groupBy("pending_id").agg(F.array_sort(F.collect_list("bank_id")).alias("members"))
    groups = claims.select(F.col("pending_id").alias("match_id"), F.col("pending_id").alias("order"), "members")
    truth = r.t("bank").select(F.col("bank_id").alias("order"), F.array("bank_id").alias("legs"))
    return score.scored_matches(groups, truth, r.findings.select(F.col("k").alias("order")))


def _ids(r: Run) -> DataFrame:
    return r.findings.select(F.concat("defect", F.lit("/"), F.col("k").cast("string")).alias("finding_id"), F.col("k").alias("order"), F.col("defect").alias("found"))


@query(f"{_SCORED} SELECT match_id, right_one AS true_positive, silent FROM sm")
def score_matches(r: Run) -> DataFrame:
    return _matches(r)


@query(f"{_SCORED} SELECT instance, o AS order_id, detected, same AS class_correct FROM sd")
def score_defects(r: Run) -> DataFrame:
    return score.scored_defects(_truth(r)[1], _ids(r)).select("instance", F.col("order").alias("order_id"), "detected", "class_correct")


def _abstained(r: Run) -> DataFrame:
    up = r.queue.where("origin = 'FINDING'").select("rank", F.element_at(F.split(F.split_part("key", F.lit("/"), F.lit(2)), "_"), -1).cast("long").alias("order"))
    return score.scored_abstentions(up, _truth(r)[0])


@query(f"{_SCORED} SELECT o AS order_id, verdict FROM sa")
def score_abstentions(r: Run) -> DataFrame:
    return _abstained(r).select(F.col("order").alias("order_id"), "verdict")


@query(f"""{_SCORED}, v AS (SELECT (SELECT COUNT(*) FROM truth) AS orders, (SELECT COUNT(*) FROM truth WHERE o IN (SELECT k FROM banked)) AS auto, (SELECT COUNT(*) FROM truth WHERE resolvable) AS res,
  (SELECT COUNT(*) FROM sm) AS gs, (SELECT COUNT(*) FROM sm WHERE right_one) AS tp, (SELECT COUNT(*) FROM sm WHERE silent) AS silent, (SELECT COUNT(*) FROM sd) AS inj, (SELECT COUNT(*) FROM sd WHERE detected) AS det, (SELECT COUNT(*) FROM sd WHERE same) AS ok,
  (SELECT SUM(CASE WHEN same THEN paise ELSE 0 END) FROM sd) AS caught, (SELECT SUM(CASE WHEN NOT detected THEN paise ELSE 0 END) FROM sd) AS missed, (SELECT COUNT(*) FROM f) AS fs,
  (SELECT COUNT(*) FROM f WHERE EXISTS (SELECT 1 FROM injected i WHERE i.o = f.k AND i.defect = f.defect)) AS rf, (SELECT SUM(amount) FROM f WHERE NOT EXISTS (SELECT 1 FROM injected i WHERE i.o = f.k AND i.defect = f.defect)) AS fa,
  (SELECT COUNT(*) FROM sa WHERE verdict = 'OVER') AS ov, (SELECT COUNT(*) FROM sa WHERE verdict = 'CORRECT') AS cor)
SELECT 'auto_match_rate' AS metric, CAST(auto AS DOUBLE) / orders AS value FROM v UNION ALL SELECT 'match_precision', CAST(tp AS DOUBLE) / gs FROM v UNION ALL SELECT 'match_recall', CAST(tp AS DOUBLE) / orders FROM v
UNION ALL SELECT 'silent_error_rate', CAST(silent AS DOUBLE) / gs FROM v UNION ALL SELECT 'defect_recall', CAST(det AS DOUBLE) / inj FROM v UNION ALL SELECT 'defect_precision', CAST(rf AS DOUBLE) / fs FROM v
UNION ALL SELECT 'root_cause_accuracy', CAST(ok AS DOUBLE) / det FROM v UNION ALL SELECT 'leakage_caught_inr', CAST(caught AS DOUBLE) FROM v UNION ALL SELECT 'leakage_missed_inr', CAST(missed AS DOUBLE) FROM v UNION ALL SELECT 'false_alarm_inr', CAST(fa AS DOUBLE) FROM v
UNION ALL SELECT 'correct_abstention_rate', CAST(cor AS DOUBLE) / (orders - res) FROM v UNION ALL SELECT 'over_abstention_rate', CAST(ov AS DOUBLE) / res FROM v UNION ALL SELECT 'residual_resolution_rate', CAST(0 AS DOUBLE) UNION ALL SELECT 'escalated_unresolved_rate', CAST(1 AS DOUBLE) UNION ALL SELECT 'exceptions_total', CAST(fs AS DOUBLE) FROM v""")
def metrics_all(r: Run) -> DataFrame:
    truth, injected = _truth(r)
    auto = truth.join(r.banked.select(F.col("k").alias("order"), F.lit(True).alias("b")), "order", "left").select("order", "resolvable", F.coalesce("b", F.lit(False)).alias("auto"))
    seeded = injected.select(F.col("order").alias("k"), "defect", F.lit(True).alias("seeded"))
    judged = r.findings.join(seeded, ["k", "defect"], "left").select(F.col("amount").alias("paise"), F.coalesce("seeded", F.lit(False)).alias("right"))
    return score.metrics(_matches(r), score.scored_defects(injected, _ids(r)), _abstained(r), judged, auto, r.findings.select(F.lit("ESCALATED_UNRESOLVED").alias("outcome")))


@query(f"""{O.LINK} SELECT 'bank_without_chain' AS "constraint", COUNT(*) AS n FROM orph UNION ALL SELECT 'shared_utr', COUNT(*) FROM (SELECT utr FROM recon GROUP BY utr HAVING COUNT(*) > 1) UNION ALL SELECT 'recon_positive', COUNT(*) FROM recon WHERE NOT (credit - debit > 0) HAVING COUNT(*) > 0""")
def constraint_violations(r: Run) -> DataFrame:
    linked = r.t("bank").withColumn("utr", F.coalesce("utr", F.lit("none")))
    return constraints.violations(
        constraints.foreign_key("bank_without_chain", linked, "utr", r.t("recon"), "utr"), constraints.unique("shared_utr", r.t("recon"), "utr"),
        constraints.holds("recon_positive", r.t("recon"), F.col("credit") - F.col("debit") > 0, "recon_id"), constraints.foreign_key("refund_payment", r.t("refund"), "payment_id", r.t("payment"), "payment_id"),
    )


@query()
def synth_world(r: Run) -> DataFrame:
    """A workload as large as the folder's, with what the checks find in it."""
    w = synth.world(r.spark, synth.tiered("T2", orders=r.t("intent").count()))
    return w.join(synth.found_in(w), "id", "left").select("id", "gross_paise", "net_paise", "credit_paise", "defect", "found")
