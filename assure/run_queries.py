"""Further queries of the catalogue: a run's numbering, constraints, reports, grounding and store."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assure import oracles as O
from assure.functions import dates, money
from assure.functions.text import record_key
from assure.operators import checks, constraints, linking, resolutions
from assure.plans import report, versions
from assure.queries import Run, long, query
from assure.sources.readers import numbered
from assure.sources.shared import checkpoint_dir, written

_K = O.record_key
_EDGES = f"""SELECT {_K("ord", "k")} AS key, 'order_id' AS field, {_K("ord", "k")} AS value FROM intent UNION ALL SELECT {_K("int", "k")}, 'order_id', {_K("ord", "k")} FROM intent
UNION ALL SELECT {_K("pay", "payment_id")}, 'order_id', {_K("ord", "order_id")} FROM payment UNION ALL SELECT {_K("pay", "payment_id")}, 'payment_id', {_K("pay", "payment_id")} FROM payment
UNION ALL SELECT {_K("trf", "transfer_id")}, 'payment_id', {_K("pay", "payment_id")} FROM transfer UNION ALL SELECT {_K("trf", "transfer_id")}, 'transfer_id', {_K("trf", "transfer_id")} FROM transfer
UNION ALL SELECT {_K("rfnd", "refund_id")}, 'payment_id', {_K("pay", "payment_id")} FROM refund UNION ALL SELECT {_K("rvsl", "reversal_id")}, 'transfer_id', {_K("trf", "transfer_id")} FROM reversal
UNION ALL SELECT {_K("disp", "dispute_id")}, 'payment_id', {_K("pay", "payment_id")} FROM dispute UNION ALL SELECT {_K("rcn", "recon_id")}, 'utr', utr FROM recon UNION ALL SELECT {_K("rcn", "recon_id")}, 'transfer_id', {_K("trf", "transfer_id")} FROM recon
UNION ALL SELECT {_K("bank", "bank_id")}, 'utr', utr FROM bank WHERE utr IS NOT NULL"""


@query(f"{O.D} {_EDGES}")
def match_p0_edges(r: Run) -> DataFrame:
    return linking.record_edges(r.records)


_GROUPS = f"""o AS (SELECT i.k, COALESCE(rc.pending_id, i.k) AS c, i.has_lines, rc.utr FROM intent i LEFT JOIN recon r ON r.transfer_id = i.k LEFT JOIN rc ON rc.utr = r.utr),
ch AS (SELECT c, BOOL_OR(has_lines) AS paid, MAX(utr) AS utr FROM o GROUP BY c),
gr AS (SELECT c AS component, 'P0' AS pass, 0 AS phase FROM ch WHERE paid AND (utr IS NULL OR utr IN (SELECT utr FROM bank WHERE utr IS NOT NULL))
  UNION ALL SELECT DISTINCT pending_id, pass, CAST(SUBSTR(pass, 2) AS INT) FROM claims UNION ALL SELECT pending_id, 'P0', 4 FROM pend WHERE pending_id NOT IN (SELECT pending_id FROM claims)),
ids AS (SELECT {_K("match", "ROW_NUMBER() OVER (ORDER BY phase, component)")} AS match_id, pass, component FROM gr)"""


@query(f"""{O.LINK}, {_GROUPS} SELECT match_id, pass, component, CASE pass WHEN 'P0' THEN 'ID_CHAIN' WHEN 'P1' THEN 'EXACT_COMPOSITE' WHEN 'P2' THEN 'GROUP_SUBSET_SUM' ELSE 'TOL_BAND' END AS rule,
  CAST(CASE pass WHEN 'P0' THEN 10000 WHEN 'P1' THEN 9500 WHEN 'P2' THEN 9000 ELSE 7000 END AS BIGINT) AS confidence_bps FROM ids""")
def match_ids(r: Run) -> DataFrame:
    return r.groups.select("match_id", "rule", "pass", *long("confidence_bps"), "component")


_FINDING_IDS = f"n AS (SELECT {_K('find', 'ROW_NUMBER() OVER (ORDER BY ' + _K('unit', 'k') + ', defect)')} AS finding_id, k, defect, amount FROM f)"


@query(f"{O.FOUND}, {_FINDING_IDS} SELECT finding_id, k, defect FROM n")
def finding_ids(r: Run) -> DataFrame:
    """Findings in the order of their units' ids as text, then of the checks."""
    rows = numbered(r.findings.withColumn("unit_id", record_key("unit", "k")), "unit_id", "defect")
    return rows.select(record_key("find", "line_no").alias("finding_id"), "k", "defect")


# constraints


@query(f"""{O.FOUND} SELECT 'rate_card_period' AS "constraint", COUNT(*) AS n FROM (SELECT 1 FROM rate_card GROUP BY seller, category, eff_from HAVING COUNT(*) > 1)
UNION ALL SELECT 'finding_unit', COUNT(*) FROM f WHERE k NOT IN (SELECT k FROM intent) UNION ALL SELECT 'finding_defect', COUNT(*) FROM f WHERE defect NOT IN ('D01', 'D02', 'D03', 'D04', 'D05', 'D06', 'D07', 'D08')
UNION ALL SELECT 'member_claimed_once', COUNT(*) FROM (SELECT bank_id FROM claims GROUP BY bank_id HAVING COUNT(DISTINCT pass) > 1)
UNION ALL SELECT 'inputs_json', COUNT(*) FROM intent WHERE k % 97 = 0 UNION ALL SELECT 'transfer_payment', COUNT(*) FROM transfer WHERE payment_id NOT IN (SELECT payment_id FROM payment)
UNION ALL SELECT 'card_in_force', COUNT(*) FROM intent i WHERE seller < 0 UNION ALL SELECT 'conservation', ABS((SELECT COUNT(*) FROM intent) - (SELECT COUNT(*) FROM u))""")
def constraint_catalogue(r: Run) -> DataFrame:
    """Every constraint with its number of violations, those without any included."""
    text = F.concat(F.lit('{"gross": '), F.when(F.col("k") % 97 != 0, F.concat(F.col("gross").cast("string"), F.lit("}"))).otherwise(F.lit("")))
    found, c = r.findings, constraints
    one = r.linked.groups.where("bank_id is not null").select("bank_id", "pass").distinct()
    named = {
        "rate_card_period": c.unique("rate_card_period", r.t("rate_card"), "seller", "category", "eff_from"),
        "finding_unit": c.foreign_key("finding_unit", found, "k", r.t("intent"), "k"),
        "finding_defect": c.holds("finding_defect", found, F.col("defect").isin(*O.CHECKS), "k"),
        "member_claimed_once": c.unique("member_claimed_once", one, "bank_id"),
        "inputs_json": c.json_valid("inputs_json", r.t("intent").select("k", text.alias("inputs")), "inputs", "k"),
        "transfer_payment": c.foreign_key("transfer_payment", r.t("transfer"), "payment_id", r.t("payment"), "payment_id"),
        "card_in_force": c.foreign_key("card_in_force", r.t("intent").select("seller"), "seller", r.t("rate_card"), "seller"),
        "conservation": c.conserved("conservation", r.t("intent").select("k"), r.units.select("k")),
    }
    return c.counted(named)


# grounding and resolutions


def _evidence(r: Run) -> DataFrame:
    """key, place, ref, role of the records that each finding cites."""
    roles = {"order": "ord", "intent": "int", "rate_card": "card", "recon_row": "rcn", "refund": "rfnd", "transfer": "trf", "reversal": "rvsl", "payment": "pay"}
    prefix = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
    rows = checks.evidence(r.findings, r.specs)
    key = F.concat("defect", F.lit("/"), record_key("ord", "k"))
    return rows.select(key.alias("key"), "role", F.regexp_replace(record_key("x", "k"), "^x", prefix[F.col("role")]).alias("ref")).withColumn("place", F.col("ref"))


_REF = "CASE role WHEN 'order' THEN 'ord' WHEN 'intent' THEN 'int' WHEN 'rate_card' THEN 'card' WHEN 'recon_row' THEN 'rcn' WHEN 'refund' THEN 'rfnd' WHEN 'transfer' THEN 'trf' WHEN 'reversal' THEN 'rvsl' ELSE 'pay' END || SUBSTR(" + _K("x", "k") + ", 2)"
_ROLES = """roles AS (SELECT * FROM (VALUES ('D01', 'order'), ('D01', 'intent'), ('D01', 'rate_card'), ('D02', 'order'), ('D02', 'recon_row'), ('D03', 'order'), ('D03', 'refund'), ('D03', 'recon_row'), ('D04', 'order'), ('D04', 'intent'),
  ('D05', 'order'), ('D05', 'intent'), ('D06', 'order'), ('D06', 'transfer'), ('D07', 'order'), ('D07', 'reversal'), ('D08', 'order'), ('D08', 'payment')) t(defect, role))"""
_EV = f"{_ROLES}, ev AS (SELECT defect || '/' || {_K('ord', 'k')} AS key, role, {_REF} AS ref FROM f JOIN roles USING (defect))"


def _subjects(r: Run) -> DataFrame:
    return r.queue.select("rank", "origin", "key", "amount", "reason", F.when(F.col("origin") == "UNMATCHED", F.col("key")).alias("record_key"))


@query(f"""{O.QUEUE}, {_EV}, fe AS (SELECT key, string_agg(ref, ',' ORDER BY ref) AS refs FROM ev GROUP BY key)
SELECT rank AS key, CASE WHEN rank % 5 = 0 THEN 'gathered' WHEN origin = 'FINDING' THEN 'finding' ELSE 'subject' END AS grounds, CASE WHEN rank % 5 = 0 THEN 'tool_' || CAST(rank AS VARCHAR) WHEN origin = 'FINDING' THEN fe.refs ELSE q.key END AS refs FROM queue q LEFT JOIN fe ON fe.key = q.key""")
def escalation_grounds(r: Run) -> DataFrame:
    """By rank, since a record may be the subject of several exceptions."""
    subjects = _subjects(r)
    gathered = r.queue.where("rank % 5 = 0").select(F.col("rank").alias("key"), F.concat(F.lit("tool_"), F.col("rank").cast("string")).alias("ref"))
    cited = subjects.where("origin = 'FINDING'").join(_evidence(r).select("key", "ref"), "key").select(F.col("rank").alias("key"), "ref")
    rows = resolutions.grounded(subjects.select(F.col("rank").alias("key"), "origin", "record_key"), gathered, cited)
    return rows.select("key", "grounds", F.array_join("refs", ",").alias("refs"))


@query(f"""{O.QUEUE}, v AS (SELECT rank, CASE WHEN rank % 4 = 0 THEN NULL ELSE 'hint' END AS resolve, rank % 3 AS h, CASE WHEN rank % 2 = 0 THEN 2 END AS chosen, rank % 7 = 0 AS trivial, rank % 11 AS ev, rank * 3 AS bps FROM queue)
SELECT rank AS key, 'escalation_needs_hint' AS rule FROM v WHERE resolve IS NULL UNION ALL SELECT rank, 'two_hypotheses' FROM v WHERE NOT trivial AND h < 2 UNION ALL SELECT rank, 'chosen_in_range' FROM v WHERE chosen >= h
UNION ALL SELECT rank, 'evidence' FROM v WHERE ev < 1 UNION ALL SELECT rank, 'confidence' FROM v WHERE bps > 10000""")
def resolution_invariants(r: Run) -> DataFrame:
    n = F.col("rank")
    rows = r.queue.select(
        n.alias("key"), F.lit("ESCALATED_UNRESOLVED").alias("outcome"), (n * 3).alias("confidence_bps"), (n % 3).alias("n_hypotheses"), F.when(n % 2 == 0, 2).alias("chosen"),
        (n % 11).alias("n_evidence"), F.when(n % 4 != 0, "hint").alias("resolve"), (n % 7 == 0).alias("trivial"),
    )
    return resolutions.violations(rows).select(*long("key"), "rule")


@query(f"""{O.QUEUE} SELECT key, rank, sha256('confidence_bps=0' || chr(10) || 'outcome=ESCALATED_UNRESOLVED' || chr(10) || 'resolve=' || '{resolutions.HINTS["tool_failure"]}' || chr(10) || 'stop_reason=tool_failure' || chr(10) || 'tried=the investigation was stopped before any tool call completed') AS content FROM queue""")
def resolution_hashes(r: Run) -> DataFrame:
    rows = resolutions.forced(r.queue.select("key", "amount", "rank"), "tool_failure").select("key", "outcome", "confidence_bps", "stop_reason", "tried", "resolve")
    hashed = rows.select("key", resolutions.content_hash("outcome", "confidence_bps", "stop_reason", "tried", "resolve").alias("content")).distinct()
    return r.queue.select("key", "rank").join(hashed, "key").select("key", "rank", "content")


_CITED = f"""truth AS (SELECT {_K("ord", "k")} AS m FROM intent UNION SELECT {_K("trf", "transfer_id")} FROM transfer),
idx AS (SELECT {_K("ord", "k")} AS key FROM intent UNION ALL SELECT {_K("rfnd", "refund_id")} FROM refund UNION ALL SELECT {_K("pay", "payment_id")} FROM payment)"""


@query(f"""{O.D}, {_CITED}, c AS (SELECT {_K("trf", "CASE WHEN transfer_id % 50 = 1 THEN transfer_id + 10000000 ELSE transfer_id END")} AS key, TRUE AS claims FROM transfer UNION ALL SELECT {_K("rfnd", "CASE WHEN refund_id % 30 = 0 THEN refund_id + 10000000 ELSE refund_id END")}, TRUE FROM refund
  UNION ALL SELECT {_K("pay", "CASE WHEN payment_id % 70 = 3 THEN payment_id + 10000000 ELSE payment_id END")}, FALSE FROM payment)
SELECT DISTINCT key, CASE WHEN claims AND key NOT LIKE 'rfnd@_%' ESCAPE '@' THEN 'truth' ELSE 'index' END AS oracle FROM c
WHERE CASE WHEN claims AND key NOT LIKE 'rfnd@_%' ESCAPE '@' THEN key NOT IN (SELECT m FROM truth) ELSE key NOT IN (SELECT key FROM idx) END""")
def score_fabrication(r: Run) -> DataFrame:
    def moved(table: str, n: str, prefix: str, by: int, at: int, claims: bool) -> DataFrame:
        number = F.col(n) + F.when(F.col(n) % by == at, 10_000_000).otherwise(0)
        return r.t(table).select(record_key(prefix, number).alias("key"), F.lit(claims).alias("claims"))

    cited = moved("transfer", "transfer_id", "trf", 50, 1, True).unionByName(moved("refund", "refund_id", "rfnd", 30, 0, True)).unionByName(moved("payment", "payment_id", "pay", 70, 3, False))
    orders = r.t("intent").select(record_key("ord", "k").alias("key"))
    legs = r.t("transfer").groupBy("payment_id").agg(F.to_json(F.array_sort(F.collect_list(record_key("trf", "transfer_id")))).alias("legs"))
    truth = resolutions.closure(r.t("intent").join(legs, F.col("payment_id") == F.col("k"), "left").select(record_key("ord", "k").alias("order"), "legs"))
    index = orders.unionByName(r.t("refund").select(record_key("rfnd", "refund_id").alias("key"))).unionByName(r.t("payment").select(record_key("pay", "payment_id").alias("key")))
    return resolutions.fabricated(cited, orders, truth.select("member"), index)


@query(f"""{O.D} SELECT {_K("ord", "k")} AS member, {_K("ord", "k")} AS "order" FROM intent UNION ALL SELECT {_K("trf", "transfer_id")}, {_K("ord", "payment_id")} FROM transfer""")
def truth_closure(r: Run) -> DataFrame:
    legs = r.t("transfer").groupBy("payment_id").agg(F.to_json(F.collect_list(record_key("trf", "transfer_id"))).alias("legs"))
    return resolutions.closure(r.t("intent").join(legs, F.col("payment_id") == F.col("k"), "left").select(record_key("ord", "k").alias("order"), "legs"))


@query(f"""{O.QUEUE}, {_EV}, x AS (SELECT key, rank FROM queue WHERE origin = 'UNMATCHED' UNION ALL SELECT ev.ref, q.rank FROM queue q JOIN ev USING (key) WHERE origin = 'FINDING') SELECT key, MAX(rank) AS rank FROM x GROUP BY key""")
def exceptions_by_record(r: Run) -> DataFrame:
    return resolutions.by_record(_subjects(r), _evidence(r).select("key", "ref")).select("key", *long("rank"))


# reports


def _inr(x: str) -> str:
    whole = f"CAST(ABS({x}) // 100 AS VARCHAR)"
    grouped = f"CASE WHEN length({whole}) <= 3 THEN {whole} ELSE regexp_replace(reverse(regexp_replace(reverse(left({whole}, length({whole}) - 3)), '(..)', '\\1,', 'g')), '^,', '') || ',' || right({whole}, 3) END"
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || '₹' || {grouped} || '.' || lpad(CAST(ABS({x}) % 100 AS VARCHAR), 2, '0'))"


def _resolved(r: Run) -> DataFrame:
    down = F.when(F.col("rank") % 6 == 0, F.lit("amount"))
    return r.queue.select("key", "rank").groupBy("key").agg(F.min("rank").alias("rank")).select(
        "key", F.when(down.isNotNull(), "PROPOSED").otherwise("ESCALATED_UNRESOLVED").alias("outcome"), F.lit("AUTO_RESOLVED").alias("claimed"), down.alias("downgrade_reason"),
        F.lit("nothing").alias("tried"), F.when(down.isNull(), "a look").alias("resolve"),
    )


@query(f"""{O.QUEUE}, {_EV}, fe AS (SELECT key, string_agg('`' || ref || '` (' || role || ')', ', ' ORDER BY ref) AS refs FROM ev GROUP BY key), fr AS (SELECT key, MIN(rank) AS r0 FROM queue GROUP BY key)
SELECT rank, '### `' || q.key || '`  ·  ' || CASE WHEN origin = 'FINDING' THEN reason ELSE 'UNMATCHED' END || '  ·  ' || {_inr("amount")} || ' at risk' || chr(10) ||
  CASE WHEN r0 % 6 = 0 THEN '| outcome | `PROPOSED` (model claimed `AUTO_RESOLVED`, downgraded: amount) |' ELSE '| outcome | `ESCALATED_UNRESOLVED` |' END || chr(10) || '| what was tried | nothing |' ||
  CASE WHEN r0 % 6 = 0 THEN '' ELSE chr(10) || '| what would resolve it | a look |' END || COALESCE(chr(10) || '| evidence | ' || refs || ' |', '') AS section FROM queue q JOIN fr USING (key) LEFT JOIN fe ON fe.key = q.key""")
def report_exceptions(r: Run) -> DataFrame:
    """Sections without the trace, whose formulas are worded for Spark; report_with_trace has them."""
    none = r.findings.limit(0).select(F.col("defect").alias("key"), F.lit(1).alias("step_no"), F.lit("").alias("label"), F.lit("").alias("formula"), F.lit(0).alias("output"))
    return report.exception_sections(r.queue, _resolved(r), _evidence(r), none)


@query()
def report_with_trace(r: Run) -> DataFrame:
    steps = checks.trace(r.units, r.specs).withColumn("key", F.concat("defect", F.lit("/"), record_key("ord", "k")))
    return report.exception_sections(r.queue, _resolved(r), _evidence(r), steps)


@query(f"""{O.D}, m AS (SELECT r.recon_id, r.credit - r.debit - amount AS delta, GREATEST(100, {O.b("ABS(credit - debit)", 10)}) AS band FROM recon r JOIN bank ON bank_id = recon_id),
v AS (SELECT *, CASE WHEN delta <= 0 THEN 0 ELSE CAST(round_even(LEAST(1.0, CAST(delta AS DOUBLE) / band) * 4, 0) AS INT) END AS n FROM m)
SELECT recon_id, repeat('█', 16) || repeat('▏', n) || repeat(' ', 4 - n) AS bar FROM v""")
def variance_bars(r: Run) -> DataFrame:
    met = r.t("recon").join(r.t("bank").select(F.col("bank_id").alias("recon_id"), "amount"), "recon_id")
    net = F.col("credit") - F.col("debit")
    rows = met.select("recon_id", (net - F.col("amount")).alias("delta"), money.Tolerance().band(net).alias("band"))
    return rows.select("recon_id", report.variance_bar("delta", "band").alias("bar"))


@query(f"""{O.D} SELECT k, CASE WHEN gross < 0 THEN '-' ELSE '' END || CAST(ABS(gross) // 100 AS VARCHAR) || '.' || lpad(CAST(ABS(gross) % 100 AS VARCHAR), 2, '0') AS rupees, strftime(CAST(placed AS TIMESTAMP) + INTERVAL '330 minutes', '%Y-%m-%d %H:%M:%S') AS ist, CAST(epoch(CAST(placed AS TIMESTAMP)) AS BIGINT) AS seconds FROM intent""")
def f_render_source(r: Run) -> DataFrame:
    at = F.col("placed").cast("timestamp")
    return r.t("intent").select("k", money.rupee_text("gross").alias("rupees"), dates.ist_text(at).alias("ist"), F.unix_timestamp(at).alias("seconds"))


@query(f"""{O.D} SELECT i.k, COALESCE(r.n, 0) AS refunds, COALESCE(r.paise, 0) AS paise, {O.b("i.gross - COALESCE(r.paise, 0)", 50)} AS tcs_due FROM intent i LEFT JOIN (SELECT p.order_id AS k, COUNT(*) AS n, CAST(SUM(f.amount) AS BIGINT) AS paise FROM refund f JOIN payment p USING (payment_id) GROUP BY 1) r ON r.k = i.k""")
def refund_rollup(r: Run) -> DataFrame:
    per = r.t("refund").join(r.t("payment").select("payment_id", F.col("order_id").alias("k")), "payment_id").groupBy("k").agg(F.count("*").alias("n"), money.sum_paise("amount").alias("paise"))
    rows = r.t("intent").select("k", "gross").join(per, "k", "left").fillna(0, ["n", "paise"])
    return rows.select("k", F.col("n").alias("refunds"), "paise", money.apply_bps(F.col("gross") - F.col("paise"), F.lit(50)).alias("tcs_due"))


_TABLES = ("intent", "payment", "refund", "transfer", "reversal", "dispute", "recon", "bank", "rate_card")


@query(f"""{O.QUEUE}, {_EV}, {_GROUPS} {" UNION ALL ".join(f"SELECT '{t}' AS name, COUNT(*) AS n FROM {t}" for t in _TABLES)} UNION ALL SELECT 'match_group', COUNT(*) FROM ids UNION ALL SELECT 'settlement_unit', COUNT(*) FROM u
UNION ALL SELECT 'finding', COUNT(*) FROM f UNION ALL SELECT 'finding_evidence', COUNT(*) FROM ev UNION ALL SELECT 'exception', COUNT(*) FROM queue UNION ALL SELECT 'record_terminal_state', COUNT(*) FROM intent""")
def run_tables_counts(r: Run) -> DataFrame:
    """A run committed to a new folder of the shared storage, opened again and counted table by table."""
    from assure.plans.rundir import committed

    return committed(r)


# Normalisations of a row of each kind, arithmetic steps of each check
_FIELDS = {"pairs_": 3, "intent": 7, "bank": 3, "payment": 8, "transfer": 7, "refund": 4, "reversal": 4, "dispute": 5, "recon": 12}
_MONEY = {"intent": "gross", "recon": "credit"} | {t: "amount" for t in ("payment", "transfer", "refund", "reversal", "dispute", "bank")}
_STEPS = {"D01": 3, "D02": 3, "D03": 2, "D04": 2, "D05": 2, "D06": 1, "D07": 1, "D08": 2}
_KEPT = [t for t in _FIELDS if t != "pairs_"]
_N = lambda t: f"(SELECT COUNT(*) FROM {t})"


@query(f"""{O.QUEUE}, {_EV}, {_GROUPS}, pairs_ AS (SELECT * FROM rate_card),
mm AS (SELECT match_id, 'i' AS side, o.k AS n FROM ids JOIN o ON o.c = component UNION SELECT match_id, 'p', payment_id FROM ids JOIN o ON o.c = component JOIN payment ON order_id = o.k
  UNION SELECT match_id, 'r', recon_id FROM ids JOIN o ON o.c = component JOIN recon ON transfer_id = o.k UNION SELECT match_id, 'b', bank_id FROM ids JOIN o ON o.c = component JOIN bank ON bank.utr = o.utr
  UNION SELECT match_id, 'b', bank_id FROM ids JOIN claims ON pending_id = component)
{" UNION ALL ".join(f"SELECT '{t}' AS name, COUNT(*) AS n, CAST(COALESCE(SUM({_MONEY[t]}), 0) AS BIGINT) AS paise FROM {t}" for t in _KEPT)}
UNION ALL SELECT 'rate_card', COUNT(*), 0 FROM rate_card UNION ALL SELECT 'quarantine', 0, 0 UNION ALL SELECT 'transform_log', {" + ".join(f"{n} * {_N(t)}" for t, n in _FIELDS.items())}, 0
UNION ALL SELECT 'source_count', 9, 0 UNION ALL SELECT 'record_index', {" + ".join(_N(t) for t in _KEPT)}, 0 UNION ALL SELECT 'chain', {_N("intent")} + {_N("bank")}, 0
UNION ALL SELECT 'chain_routed', {_N("ch")} + {_N("orph")}, 0 UNION ALL SELECT 'link_ambiguous', COUNT(*), 0 FROM tied UNION ALL SELECT 'match_group', COUNT(*), 0 FROM ids UNION ALL SELECT 'match_member', COUNT(*), 0 FROM mm
UNION ALL SELECT 'settlement_unit', COUNT(*), 0 FROM u UNION ALL SELECT 'finding', COUNT(*), CAST(SUM(amount) AS BIGINT) FROM f UNION ALL SELECT 'finding_evidence', COUNT(*), 0 FROM ev
UNION ALL SELECT 'recompute_step', CAST(SUM(CASE defect {" ".join(f"WHEN '{d}' THEN {n}" for d, n in _STEPS.items())} END) AS BIGINT), 0 FROM f
UNION ALL SELECT 'queue', COUNT(*), CAST(SUM(amount) AS BIGINT) FROM queue UNION ALL SELECT 'exception', COUNT(*), CAST(SUM(amount) AS BIGINT) FROM queue UNION ALL SELECT 'resolution', COUNT(*), CAST(SUM(amount) AS BIGINT) FROM queue
UNION ALL SELECT 'record_terminal_state', COUNT(*), 0 FROM intent""")
def commit_from_files(r: Run) -> DataFrame:
    """The tables as four source files, and these taken to a committed run: rows and money of each of its tables."""
    from assure.plans import ingest, source_files

    own = uuid.uuid4().hex
    folder, run_dir = (f"{checkpoint_dir(r.spark)}/{what}-{own}" for what in ("files", "run"))
    source_files.write(r.records, folder)
    ingest.commit_from_files(r.spark, folder, run_dir)
    return ingest.summary(r.spark, run_dir)


# Investigations by the playbook, from recorded answers


def _investigated(r: Run):
    """Every exception of the queue investigated by the playbook: its answers are recorded in a store, then replayed from it."""
    from assure.operators.tools import Evidence
    from assure.plans import investigate, playbook
    from assure.sources import replay

    if "investigated" not in r.__dict__:
        store = f"{checkpoint_dir(r.spark)}/answers-{uuid.uuid4().hex}"
        cites = r.queue.select("rank", "key").join(_evidence(r).select("key", "ref"), "key").select("rank", "ref")
        client = replay.recorded(r.spark, store, replay.scripted(playbook.script(r)))
        found = investigate.investigate(_subjects(r), cites, Evidence(r.records), client, "playbook", "none")
        r.__dict__["investigated"] = investigate.Investigation(written(found.resolutions), written(found.calls), written(found.gathered), found.evidence)
    return r.__dict__["investigated"]


_PLAY = f"""s AS (SELECT *, CASE WHEN origin = 'FINDING' THEN CAST(SUBSTR(key, 9) AS BIGINT) END AS k, CASE WHEN origin <> 'FINDING' THEN CAST(SUBSTR(key, 6) AS BIGINT) END AS b FROM queue),
per_day AS (SELECT settled, COUNT(*) AS n FROM recon GROUP BY settled), r_n AS (SELECT payment_id, COUNT(*) AS n FROM refund GROUP BY 1), d_n AS (SELECT payment_id, COUNT(*) AS n FROM dispute GROUP BY 1),
c_n AS (SELECT i.k, COUNT(c.seller) AS n FROM intent i LEFT JOIN rate_card c ON c.seller = i.seller AND i.placed BETWEEN c.eff_from AND COALESCE(c.eff_to, i.placed) GROUP BY i.k), c_any AS (SELECT DISTINCT seller FROM rate_card),
x AS (SELECT s.*, COALESCE(pd.n, 0) AS day_n, COALESCE(r_n.n, 0) AS r_n, COALESCE(d_n.n, 0) AS d_n, COALESCE(c_n.n, 0) AS c_n, CAST(p.payment_id IS NOT NULL AS INT) AS p_n, CAST(t.transfer_id IS NOT NULL AS INT) AS t_n, CAST(ca.seller IS NOT NULL AS INT) AS has_card
  FROM s LEFT JOIN intent i ON i.k = s.k LEFT JOIN c_any ca ON ca.seller = i.seller LEFT JOIN c_n ON c_n.k = s.k LEFT JOIN payment p ON p.order_id = s.k LEFT JOIN transfer t ON t.payment_id = p.payment_id
  LEFT JOIN r_n ON r_n.payment_id = p.payment_id LEFT JOIN d_n ON d_n.payment_id = p.payment_id LEFT JOIN bank ON bank.bank_id = s.b LEFT JOIN per_day pd ON pd.settled = bank.credited)"""


@query(f"""{O.QUEUE}, {_PLAY} SELECT rank, CASE WHEN origin = 'FINDING' THEN 'PROPOSED' ELSE 'ESCALATED_UNRESOLVED' END AS outcome, CASE WHEN reason = 'D03' THEN 3 ELSE 2 END AS rounds,
  CAST(CASE WHEN reason IN ('D01', 'D02', 'D08', 'D03') THEN 2 ELSE 1 END AS BIGINT) AS calls,
  CAST(CASE reason WHEN 'D01' THEN 1 - has_card WHEN 'D02' THEN 2 - p_n - t_n WHEN 'D03' THEN 2 - 2 * p_n WHEN 'D06' THEN 1 - t_n WHEN 'D07' THEN 1 - t_n WHEN 'D08' THEN 2 - p_n - LEAST(d_n, 1) ELSE 0 END AS BIGINT) AS failed,
  CAST(CASE reason WHEN 'D01' THEN 1 + c_n WHEN 'D02' THEN p_n + t_n WHEN 'D03' THEN p_n + r_n WHEN 'D04' THEN 1 WHEN 'D05' THEN 1 WHEN 'D06' THEN t_n WHEN 'D07' THEN t_n WHEN 'D08' THEN p_n + LEAST(d_n, 1) ELSE day_n END AS BIGINT) AS evidence FROM x""")
def investigation_rounds(r: Run) -> DataFrame:
    """Outcome, rounds, tool calls, those that failed, and distinct records gathered of each exception."""
    found = _investigated(r)
    tool = F.col("pos") > 0
    calls = found.calls.groupBy("rank").agg(F.count_if(tool).alias("calls"), F.count_if(tool & F.col("error").isNotNull()).alias("failed"))
    rows = found.resolutions.join(calls, "rank").join(found.gathered, "rank", "left")
    return rows.select("rank", "outcome", F.col("iterations").alias("rounds"), "calls", "failed", F.coalesce("evidence", F.lit(0)).cast("long").alias("evidence"))


@query(f"""{O.QUEUE} SELECT tool, COUNT(*) AS calls FROM (SELECT UNNEST(CASE reason WHEN 'D01' THEN ['search_intent_ledger', 'fetch_rate_card'] WHEN 'D02' THEN ['fetch_payment', 'fetch_transfer']
  WHEN 'D03' THEN ['fetch_payment', 'fetch_refunds_for_payment', 'model_turn'] WHEN 'D04' THEN ['search_intent_ledger'] WHEN 'D05' THEN ['search_intent_ledger'] WHEN 'D06' THEN ['fetch_transfer'] WHEN 'D07' THEN ['fetch_transfer']
  WHEN 'D08' THEN ['fetch_payment', 'fetch_dispute'] ELSE ['fetch_settlement_recon'] END || ['model_turn', 'submit_resolution']) AS tool FROM queue) GROUP BY tool""")
def investigation_calls(r: Run) -> DataFrame:
    """Turns and tool calls of all investigations, by tool."""
    return _investigated(r).calls.groupBy("tool").agg(F.count("*").alias("calls"))


# A stored run: scored from its folder alone, and compared with one made anew


def _stored(r: Run):
    """The run committed with its investigations to a new folder, and opened again."""
    from assure.plans import rundir
    from assure.plans.stored import StoredRun

    started, run_dir = time.time(), f"{checkpoint_dir(r.spark)}/run-{uuid.uuid4().hex}"
    found = _investigated(r)
    cites = _evidence(r).select(F.col("key").alias("finding_ref"), F.col("ref").alias("key"), "role")
    rundir.commit(r, run_dir, more=rundir.investigated(r, found, cites), started_at=started)
    return StoredRun(r.spark, run_dir)


def _truth_of(r: Run):
    """Each paid order stands alone: its ledger row, payment, settlement row and the credit that bears its number."""
    from assure.plans.stored import Truth
    from assure.queries import _truth

    orders, injected = _truth(r)
    named = lambda rows, n, prefix: rows.select(F.col(n).alias("order"), record_key(prefix, n).alias("member"))
    legs = named(r.t("intent"), "k", "int").unionByName(named(r.t("payment"), "payment_id", "pay")).unionByName(named(r.t("recon"), "recon_id", "rcn")).unionByName(named(r.t("bank"), "bank_id", "bank"))
    as_key = lambda df: df.withColumn("order", record_key("ord", "order"))
    return Truth(as_key(legs.join(orders.select("order"), "order")), as_key(orders), as_key(injected))


_SIDES = {"i": "int", "p": "pay", "r": "rcn", "b": "bank"}
_STORED = f"""mm AS (SELECT match_id, 'i' AS side, o.k AS n FROM ids JOIN o ON o.c = component UNION SELECT match_id, 'p', payment_id FROM ids JOIN o ON o.c = component JOIN payment ON order_id = o.k
  UNION SELECT match_id, 'r', recon_id FROM ids JOIN o ON o.c = component JOIN recon ON transfer_id = o.k UNION SELECT match_id, 'b', bank_id FROM ids JOIN o ON o.c = component JOIN bank ON bank.utr = o.utr
  UNION SELECT match_id, 'b', bank_id FROM ids JOIN claims ON pending_id = component),
tr AS (SELECT k AS o, k % 6 <> 0 AS resolvable FROM intent WHERE has_lines), lg AS (SELECT side, n, o FROM (SELECT 'i' AS side, k AS n FROM intent UNION ALL SELECT 'p', payment_id FROM payment UNION ALL SELECT 'r', recon_id FROM recon UNION ALL SELECT 'b', bank_id FROM bank) z JOIN tr ON tr.o = z.n),
ij AS (SELECT 'i' || CAST(k AS VARCHAR) AS instance, k AS o, 'D01' AS defect, 1000 AS paise FROM intent WHERE has_lines AND k % 37 = 0 UNION ALL SELECT 'j' || CAST(k AS VARCHAR), k, 'D05', 500 FROM intent WHERE has_lines AND k % 59 = 0),
ct AS (SELECT key FROM queue WHERE origin = 'UNMATCHED' UNION SELECT ref FROM ev), mk AS (SELECT mm.*, lg.o, CASE side {" ".join(f"WHEN '{s}' THEN {_K(p, 'n')}" for s, p in _SIDES.items())} END AS key FROM mm LEFT JOIN lg USING (side, n)),
gj AS (SELECT match_id, COUNT(*) AS n, COUNT(o) AS known, MIN(o) AS a, MAX(o) AS z, BOOL_OR(key IN (SELECT key FROM ct)) AS cited, BOOL_OR(side = 'i' AND n IN (SELECT k FROM f)) AS found FROM mk GROUP BY match_id),
sm AS (SELECT match_id, cited, found, COALESCE(gj.n = known AND a = z AND gj.n = (SELECT COUNT(*) FROM lg WHERE lg.o = gj.a), FALSE) AS good FROM gj),
au AS (SELECT lg.o, COUNT(*) = COUNT(mm.match_id) AND MIN(mm.match_id) = MAX(mm.match_id) AS auto FROM lg LEFT JOIN (SELECT side, n, MAX(match_id) AS match_id FROM mm GROUP BY 1, 2) mm USING (side, n) GROUP BY lg.o),
sd AS (SELECT i.instance, i.paise, COUNT(f.k) > 0 AS detected, COALESCE(BOOL_OR(f.defect = i.defect), FALSE) AS same FROM ij i LEFT JOIN f ON f.k = i.o GROUP BY 1, 2),
fs AS (SELECT f.amount, EXISTS (SELECT 1 FROM ij WHERE ij.o = f.k AND ij.defect = f.defect) AS good FROM f),
sa AS (SELECT resolvable FROM tr WHERE o IN (SELECT k FROM f)),
v AS (SELECT (SELECT COUNT(*) FROM tr) AS os, (SELECT COUNT(*) FROM tr WHERE resolvable) AS res, (SELECT COUNT(*) FROM au WHERE auto) AS auto, (SELECT COUNT(*) FROM sm) AS gs, (SELECT COUNT(*) FROM sm WHERE good) AS tp,
  (SELECT COUNT(*) FROM sm WHERE NOT good AND NOT cited AND NOT found) AS silent, (SELECT COUNT(*) FROM sd) AS inj, (SELECT COUNT(*) FROM sd WHERE detected) AS det, (SELECT COUNT(*) FROM sd WHERE same) AS ok,
  (SELECT COALESCE(SUM(paise), 0) FROM sd WHERE same) AS caught, (SELECT COALESCE(SUM(paise), 0) FROM sd WHERE NOT detected) AS missed, (SELECT COUNT(*) FROM fs) AS fn, (SELECT COUNT(*) FROM fs WHERE good) AS fg,
  (SELECT COALESCE(SUM(amount), 0) FROM fs WHERE NOT good) AS fa, (SELECT COUNT(*) FROM sa WHERE resolvable) AS ov, (SELECT COUNT(*) FROM sa WHERE NOT resolvable) AS cor, (SELECT COUNT(*) FROM queue) AS q, (SELECT COUNT(*) FROM queue WHERE origin = 'FINDING') AS prop)"""
_VALUES = {
    "auto_match_rate": "auto / os", "match_precision": "tp / gs", "match_recall": "tp / os", "silent_error_rate": "silent / gs", "defect_recall": "det / inj", "defect_precision": "fg / fn", "root_cause_accuracy": "ok / det",
    "leakage_caught_inr": "caught", "leakage_missed_inr": "missed", "false_alarm_inr": "fa", "correct_abstention_rate": "cor / (os - res)", "over_abstention_rate": "ov / res", "records_per_second": "NULL", "wall_clock_seconds_total": "NULL",
    "llm_tokens_per_1000_records": "0", "inr_cost_per_1000_records": "NULL", "determinism_score": "NULL", "residual_resolution_rate": "prop / q", "escalated_unresolved_rate": "(q - prop) / q", "exceptions_total": "q",
    "auto_resolved_count": "0", "proposed_count": "prop", "escalated_unresolved_count": "q - prop",
}


@query(f"{O.QUEUE}, {_EV}, {_GROUPS}, {_STORED} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({x} AS DOUBLE) AS value FROM v" for m, x in _VALUES.items()))
def stored_run_metrics(r: Run) -> DataFrame:
    """The 23 metrics of a run that was committed and opened again; times, which differ from run to run, are left out here."""
    from assure.plans import stored

    rows = stored.metrics(_stored(r), _truth_of(r))
    return rows.select("metric", F.when(~F.col("metric").isin("records_per_second", "wall_clock_seconds_total"), F.col("value")).alias("value"))


@query(f"{O.QUEUE} SELECT CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM queue) AS score FROM queue")
def determinism_score(r: Run) -> DataFrame:
    """Two runs made anew from the tables and committed; the share of the first one's exceptions that come out the same."""
    from assure.plans import score, stored

    runs = [_stored(Run(r.spark, r.sf_dir)) for _ in range(2)]
    return score.determinism(stored.observed(runs), runs[0].table("exception").count())


@query(f"""{O.QUEUE} SELECT CAST(CASE WHEN origin = 'FINDING' THEN 1 ELSE 2 END AS BIGINT) AS version, COUNT(*) AS n, CAST(SUM(amount) AS BIGINT) AS paise, TRUE AS intact FROM queue GROUP BY ALL""")
def append_only_versions(r: Run) -> DataFrame:
    """The queue as an append-only table: its findings, then all of it, of which the findings are there already."""
    path = f"{checkpoint_dir(r.spark)}/versions-{uuid.uuid4().hex}"
    rows = r.queue.select("rank", "origin", "key", "amount")
    for part in (rows.where("origin = 'FINDING'"), rows):
        versions.append(r.spark, path, part, "rank")
    sums = versions.table(r.spark, path).groupBy("version").agg(F.count("*").alias("n"), money.sum_paise("amount").alias("paise"))
    return sums.join(versions.intact(r.spark, path), "version").select(*long("version", "n", "paise"), "intact")
