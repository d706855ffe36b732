"""From the four source files to a committed run: ordered stages, each of whose tables is written once and kept by a restart.

A run's folder holds a folder for each table and, at last, the manifest. A stage's tables are written in order; what a
lost driver has left whole (a table with its commit marker) is read, what it left half is written anew. The first thing
written is what the run is of: the files' digests and the settings; a restart over other files is refused.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assure.functions.money import sum_paise
from assure.functions.text import record_key
from assure.operators import checks, triage
from assure.operators.linking import Linked, numbered_groups
from assure.oracles import BANK_NODE
from assure.plans import rundir, runstore
from assure.plans.projection import AS_OF
from assure.queries import Run
from assure.sources import normalise, readers
from assure.sources.shared import checkpoint_dir, exists, small_tasks

FILES = {"sellers": "sellers.csv", "intent": "intent.csv", "bank": "bank.csv", "razorpay": "razorpay.json"}
#: A record's side and the prefix of its key.
KINDS = {"intent": ("intent", "int"), "payment": ("razorpay", "pay"), "transfer": ("razorpay", "trf"), "refund": ("razorpay", "rfnd"), "reversal": ("razorpay", "rvsl"), "dispute": ("razorpay", "disp"), "recon": ("razorpay", "rcn"), "bank": ("bank", "bank")}
#: Nodes of settlement rows that belong to no order.
LOOSE = 2_000_000_000_000


class InputsChanged(Exception):
    """The folder holds a run of other files or settings."""


class FileRun(Run):
    """A Run over source files; every table it makes is kept in run_dir, so that a restart goes on where it ended."""

    def __init__(self, spark: SparkSession, folder: str, run_dir: str):
        checkpoint_dir(spark)
        small_tasks(spark, [f"{folder}/{file}" for file in FILES.values()])
        self.spark, self.sf_dir, self.run_dir, self.folder = spark, folder, run_dir, folder
        self.records, self.specs = self, checks.checks(AS_OF)

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.run_dir}/{name}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            rows = make()
            if not exists(self.spark, f"{path}/_SUCCESS"):  # make() may be what keeps it
                rows.write.mode("overwrite").parquet(path)  # what a lost run left half is replaced
        return self.spark.read.parquet(path)

    # ingest

    @cached_property
    def raw(self) -> dict[str, DataFrame]:
        files = {name: f"{self.folder}/{file}" for name, file in FILES.items()}
        rows = {name: self.kept(f"raw_{name}", lambda name=name: readers.csv_rows(self.spark, files[name], name)) for name in ("sellers", "intent", "bank")}
        return rows | {"razorpay": self.kept("raw_razorpay", lambda: readers.processor_rows(self.spark, files["razorpay"]))}

    @cached_property
    def parsed(self) -> dict[str, tuple[DataFrame, tuple]]:
        """Canonical kind to its raw rows and the fields to be made of them."""
        of = {"seller": (self.raw["sellers"], normalise.sellers_fields()), "intent": (self.raw["intent"], normalise.intent_fields()), "bank": (self.raw["bank"], normalise.bank_fields())}
        for kind, array in zip(("payment", "transfer", "refund", "reversal", "dispute", "recon"), readers.ARRAYS):
            of[kind] = (self.raw["razorpay"].where(F.col("kind") == array), normalise.PROCESSOR[array]())
        return of

    def normal(self, kind: str) -> DataFrame:
        return normalise.normalised(*self.parsed[kind], kind)

    def valid(self, kind: str) -> DataFrame:
        return normalise.split(self.normal(kind))[0]

    def quarantine(self) -> DataFrame:
        """raw_id, source, reason, detail of every row that was not taken."""
        return reduce(DataFrame.unionByName, [normalise.split(self.normal(kind))[1].select("raw_id", "source", F.col("quarantine_reason").alias("reason"), F.col("quarantine_detail").alias("detail")) for kind in self.parsed])

    def lineage(self) -> DataFrame:
        """raw_id, step, field, before_text, after_text, rule_id of every normalisation."""
        return reduce(DataFrame.unionByName, [normalise.lineage(raw, fields, "raw_id") for raw, fields in self.parsed.values()])

    def counts(self) -> DataFrame:
        """source, total, normalised, quarantined."""
        return reduce(DataFrame.unionByName, [normalise.counts(self.normal(kind), kind) for kind in self.parsed])

    def t(self, name: str) -> DataFrame:
        """A canonical table. Keys are line numbers; a row whose parent is not in the files has a null for it."""
        made = {"intent": self._intent, "rate_card": self._rate_card, "payment": self._payment, "transfer": self._transfer, "refund": self._refund, "reversal": self._reversal, "dispute": self._dispute, "recon": self._recon, "bank": self._bank}
        return self.kept(name, made[name])

    table = t

    def _intent(self) -> DataFrame:
        rows = normalise.resolved_sellers(self.valid("intent"), self.valid("seller"))
        return rows.select(
            F.col("line_no").alias("k"), "order_id", F.col("seller_id").alias("seller"), "resolution", "category", F.col("placed_at_utc").cast("date").alias("placed"), F.col("status").alias("st"), "is_interstate",
            F.col("gross_paise").alias("gross"), F.col("commission_rate_applied_bps").alias("applied_bps"), F.col("commission_paise").alias("commission"), (F.col("gross_paise") - F.col("commission_paise")).alias("expected_seller"),
            F.col("expected_tcs_paise").alias("tcs"), F.col("expected_tds_paise").alias("tds"), "rate_card_version",
        )

    def _rate_card(self) -> DataFrame:
        return self.valid("seller").select(F.col("seller_id").alias("seller"), "category", F.col("commission_bps_n").alias("bps"), F.col("effective_from_d").alias("eff_from"), F.col("effective_to_d").alias("eff_to"), F.col("version").try_cast("int").alias("ver"))

    def _keyed(self, kind: str, number: str, **columns: str | Column) -> DataFrame:
        return self.valid(kind).select(F.col("line_no").alias(number), *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])

    def _child(self, rows: DataFrame, ref: str, parent: DataFrame, parent_ref: str, number: str) -> DataFrame:
        """rows with number, the parent's key, in place of ref, its id in the files; of several parents of one id the first line."""
        parents = parent.groupBy(F.col(parent_ref).alias("_ref")).agg(F.min(number).alias(number))
        return rows.join(parents, rows[ref] == parents["_ref"], "left").drop("_ref", ref)

    def _payment(self) -> DataFrame:
        rows = self._keyed("payment", "payment_id", ref="payment_id", order_ref="order_id", amount="amount_paise", method="method", captured=F.col("captured_at_utc").cast("date"), fee="fee_paise", tax="tax_paise")
        return self._child(rows, "order_ref", self.t("intent").select(F.col("order_id").alias("o"), "k"), "o", "k").withColumnRenamed("k", "order_id")

    def _transfer(self) -> DataFrame:
        rows = self._keyed("transfer", "transfer_id", ref="transfer_id", pay="payment_id", amount="amount_paise", on_hold="on_hold", hold_until=F.col("on_hold_until_utc").cast("date"), settled=F.col("settled_at_utc").cast("date"))
        return self._child(rows, "pay", self.t("payment"), "ref", "payment_id")

    def _refund(self) -> DataFrame:
        rows = self._keyed("refund", "refund_id", pay="payment_id", amount="amount_paise", created=F.col("created_at_utc").cast("date"))
        return self._child(rows, "pay", self.t("payment"), "ref", "payment_id")

    def _dispute(self) -> DataFrame:
        rows = self._keyed("dispute", "dispute_id", pay="payment_id", amount="amount_paise", status="status", deducted="deducted_amount_paise")
        return self._child(rows, "pay", self.t("payment"), "ref", "payment_id")

    def _reversal(self) -> DataFrame:
        rows = self._keyed("reversal", "reversal_id", trf="transfer_id", amount="amount_paise", created=F.col("created_at_utc").cast("date"))
        return self._child(rows, "trf", self.t("transfer"), "ref", "transfer_id")

    def _recon(self) -> DataFrame:
        rows = self._keyed("recon", "recon_id", trf="entity_key", settlement="settlement_id", utr="utr", credit="credit_paise", debit="debit_paise", settled=F.col("settled_at_utc").cast("date"))
        rows = self._child(rows, "trf", self.t("transfer"), "ref", "transfer_id")
        numbers = rows.groupBy("settlement").agg(F.min("recon_id").alias("settlement_id"))
        rows = rows.join(numbers, "settlement").drop("settlement")
        order = self.t("transfer").join(self.t("payment").select("payment_id", F.col("order_id").alias("order_k")), "payment_id").select("transfer_id", "order_k")
        return rows.join(order, "transfer_id", "left")

    def _bank(self) -> DataFrame:
        return self._keyed("bank", "bank_id", utr="utr", amount="amount_paise", credited="credited_on", bank_ref="bank_ref", narration="narration")

    # match, verify, triage: as in any run, each result kept

    @cached_property
    def placed_recon(self) -> DataFrame:
        return self.t("recon").withColumn("transfer_id", F.coalesce("order_k", F.col("recon_id") + F.lit(LOOSE)))

    @cached_property
    def placed_payment(self) -> DataFrame:
        return self.t("payment").where("order_id IS NOT NULL")

    @property
    def bank_named(self) -> Column:
        """The number in the file's own reference as a key: line numbers, as text, fall in another order than the references do."""
        number = F.regexp_extract("bank_ref", r"(\d+)$", 1)
        return F.coalesce(F.when(number != "", record_key("bank", number)), "bank_ref", record_key("bank", "bank_id"))

    @cached_property
    def chains(self) -> DataFrame:
        return self.kept("chain", lambda: Run.chains.func(self))

    @cached_property
    def routed(self) -> DataFrame:
        return self.kept("chain_routed", lambda: Run.routed.func(self))

    @cached_property
    def linked(self) -> Linked:
        names = ("link_group", "link_ambiguous", "link_unmatched")
        if not all(exists(self.spark, f"{self.run_dir}/{n}/_SUCCESS") for n in names):
            made = Run.linked.func(self)
            for n, rows in zip(names, (made.groups, made.ambiguous, made.unmatched_banks)):
                self.kept(n, lambda rows=rows: rows)
        return Linked(*(self.spark.read.parquet(f"{self.run_dir}/{n}") for n in names))

    @cached_property
    def groups(self) -> DataFrame:
        return self.kept("match_group", lambda: numbered_groups(self.routed, self.linked))

    @cached_property
    def units(self) -> DataFrame:
        return self.kept("unit_amounts", lambda: Run.units.func(self))

    @cached_property
    def queue(self) -> DataFrame:
        return self.kept("queue", lambda: Run.queue.func(self))

    # what only a run of files has

    def record_index(self) -> DataFrame:
        """key, entity, side of every record."""
        number = {"intent": "k", "recon": "recon_id", "bank": "bank_id"}
        return reduce(DataFrame.unionByName, [self.t(kind).select(record_key(prefix, number.get(kind, f"{kind}_id")).alias("key"), F.lit(kind).alias("entity"), F.lit(side).alias("side")) for kind, (side, prefix) in KINDS.items()])

    def match_member(self) -> DataFrame:
        return rundir.match_member(self, self.groups)

    def steps(self) -> DataFrame:
        return checks.trace(self.units, self.specs)

    def resolution(self) -> DataFrame:
        return triage.rules_only(self.queue)


def _stages(run: FileRun) -> list[tuple[str, dict[str, Callable[[], DataFrame]]]]:
    """Stages in order, and what makes each of their tables."""
    canonical = {name: (lambda name=name: run.t(name)) for name in rundir.CANONICAL}
    of_run = cached(lambda: rundir.tables(run))
    later = lambda *names: {n: (lambda n=n: of_run()[n]) for n in names}
    return [
        ("ingest", canonical | {"quarantine": run.quarantine, "transform_log": run.lineage, "source_count": run.counts, "record_index": run.record_index}),
        ("match", {"chain": lambda: run.chains, "chain_routed": lambda: run.routed, "link_ambiguous": lambda: run.linked.ambiguous} | later("match_group") | {"match_member": run.match_member}),
        ("verify", later("settlement_unit", "finding", "finding_evidence") | {"recompute_step": run.steps}),
        ("triage", {"queue": lambda: run.queue} | later("exception") | {"resolution": run.resolution} | later("record_terminal_state")),
    ]


def cached(make: Callable) -> Callable:
    held: list = []
    return lambda: held[0] if held else held.append(make()) or held[0]


def fingerprint(df: DataFrame) -> DataFrame:
    """n, digest of a table whatever the order of its rows: sums of row hashes."""
    plain = [F.to_json(F.col(f.name)) if f.dataType.typeName() in ("array", "struct", "map", "variant") else F.col(f.name) for f in df.schema]
    h = F.xxhash64(*plain).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))


def commit_from_files(spark: SparkSession, folder: str, run_dir: str, label: str = "HELD_OUT", dirty: bool = False, after: Callable[[str, str], None] = lambda stage, table: None) -> dict:
    """Take the four files of folder to a committed run in run_dir; gives the manifest.

    A run that was lost midway is gone on with: its whole tables are read, the others made. `after` is called with each
    table that is done. Constraints are checked before the manifest, which holds the rows and a digest of every table.
    """
    sources = readers.provenance(spark, [f"{folder}/{file}" for file in FILES.values()])
    of = {"files": sorted((r["path"].rstrip("/").split("/")[-2 if "/part-" in r["path"] else -1], r["sha256"], r["bytes"]) for r in sources.collect()), "label": label, "as_of": AS_OF}
    text = json.dumps(of, sort_keys=True)
    if exists(spark, f"{run_dir}/inputs/_SUCCESS"):
        if spark.read.text(f"{run_dir}/inputs").head()[0] != text:
            raise InputsChanged(run_dir)
    else:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{run_dir}/inputs")
    run = FileRun(spark, folder, run_dir)
    tables: dict[str, DataFrame] = {}
    stages = _stages(run)
    for stage, makers in stages:
        for name, make in makers.items():
            tables[name] = run.kept(name, make)
            after(stage, name)
    if not exists(spark, f"{run_dir}/manifest.json/_SUCCESS"):
        prints = reduce(DataFrame.unionByName, [fingerprint(df).withColumn("name", F.lit(name)) for name, df in tables.items()])
        digests = {r["name"]: {"rows": r["n"], "digest": r["digest"]} for r in prints.collect()}  # a row a table
        manifest = {"sample_label": label, "git_dirty": dirty, "rate_as_of": AS_OF, "stages": {s: sorted(m) for s, m in stages}, "tables": sorted(tables), "inputs": of["files"], "digests": digests}
        runstore.commit(spark, run_dir, {}, manifest, rundir.checks_of(tables))
    return runstore.opened(spark, run_dir, allow_dirty=dirty)[0]


def summary(spark: SparkSession, run_dir: str) -> DataFrame:
    """name, n, paise (of its amounts) of each table of a committed run."""
    manifest, _ = runstore.opened(spark, run_dir)

    def of(name: str) -> DataFrame:
        rows = spark.read.parquet(f"{run_dir}/{name}")
        money = next((c for c in ("amount", "gross", "credit", "amount_at_risk_paise") if c in rows.columns), None)
        return rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"), (sum_paise(money) if money else F.lit(0).cast("long")).alias("paise"))

    return reduce(DataFrame.unionByName, [of(name) for name in manifest["tables"]])
