"""The queries' SQL for DuckDB: the canonical tables' text is the projection's, all from the linking on is written apart."""

from __future__ import annotations

from assure.plans.projection import AS_OF, bps, with_clause

BANK_NODE = 1_000_000_000_000
D = with_clause("//", "narration")


def b(a: str, rate) -> str:
    return bps(a, str(rate), "//")


LINK = f"""{D},
rc AS (SELECT utr, MIN(transfer_id) AS pending_id, CAST(SUM(credit - debit) AS BIGINT) AS target_paise, arg_min(settlement_id, transfer_id) AS settlement_id,
  arg_min(settled, transfer_id) AS settled FROM recon GROUP BY utr),
pend AS (SELECT * FROM rc WHERE utr NOT IN (SELECT utr FROM bank WHERE utr IS NOT NULL)),
orph AS (SELECT * FROM bank WHERE utr IS NULL OR utr NOT IN (SELECT utr FROM recon)),
p1p AS (SELECT pending_id, bank_id, COUNT(*) OVER (PARTITION BY pending_id) AS dp, COUNT(*) OVER (PARTITION BY bank_id) AS db
  FROM pend JOIN orph ON target_paise = amount AND settled = credited),
left1 AS (SELECT * FROM pend WHERE pending_id NOT IN (SELECT pending_id FROM p1p)),
free1 AS (SELECT * FROM orph WHERE bank_id NOT IN (SELECT bank_id FROM p1p)),
sums AS (SELECT settlement_id, MIN(pending_id) AS place, CAST(SUM(target_paise) AS BIGINT) AS target FROM left1 GROUP BY settlement_id),
same AS (SELECT amount AS target, COUNT(*) AS free, MIN(bank_id) AS only_bank FROM free1 GROUP BY amount),
met AS (SELECT s.*, free, only_bank, ROW_NUMBER() OVER (PARTITION BY s.target ORDER BY place) AS turn FROM sums s JOIN same USING (target)),
p2 AS (SELECT settlement_id, 'unique' AS status, only_bank AS bank_id FROM met WHERE free = 1 AND turn = 1
  UNION ALL SELECT settlement_id, 'ambiguous', f.bank_id FROM met JOIN free1 f ON f.amount = met.target WHERE free > 1),
left2 AS (SELECT * FROM left1 WHERE settlement_id NOT IN (SELECT settlement_id FROM p2)),
free2 AS (SELECT * FROM free1 WHERE bank_id NOT IN (SELECT bank_id FROM p2)),
p3p AS (SELECT pending_id, bank_id, COUNT(*) OVER (PARTITION BY pending_id) AS dp, COUNT(*) OVER (PARTITION BY bank_id) AS db
  FROM left2 JOIN free2 ON ABS(settled - credited) <= 2 AND ABS(target_paise - amount) <= GREATEST(100, {b("ABS(target_paise)", 10)})),
claims AS (SELECT pending_id, 'P1' AS pass, bank_id FROM p1p WHERE dp = 1 AND db = 1
  UNION ALL SELECT l.pending_id, 'P2', p2.bank_id FROM left1 l JOIN p2 USING (settlement_id) WHERE status = 'unique'
  UNION ALL SELECT pending_id, 'P3', bank_id FROM p3p WHERE dp = 1 AND db = 1),
tied AS (SELECT pending_id, 'P1' AS pass, bank_id FROM p1p WHERE NOT (dp = 1 AND db = 1)
  UNION ALL SELECT l.pending_id, 'P2', p2.bank_id FROM left1 l JOIN p2 USING (settlement_id) WHERE status = 'ambiguous'
  UNION ALL SELECT pending_id, 'P3', bank_id FROM p3p WHERE NOT (dp = 1 AND db = 1)),
loose AS (SELECT bank_id, amount FROM orph WHERE bank_id NOT IN (SELECT bank_id FROM claims)),
banked AS (SELECT transfer_id AS k FROM recon WHERE utr IN (SELECT utr FROM bank WHERE utr IS NOT NULL)
  UNION SELECT transfer_id FROM recon JOIN rc USING (utr) JOIN claims USING (pending_id))"""

def _joined(n: int) -> str:
    """Subsets of n credits of a week, by n - 1 self-joins."""
    names = [f"c{i}" for i in range(n)]
    joins = " ".join(f"JOIN c {b} ON {b}.week = {a}.week AND {b}.i > {a}.i" for a, b in zip(names, names[1:]))
    return f"SELECT c0.week, [{', '.join(f'{x}.bank_id' for x in names)}] AS m, {' + '.join(f'{x}.amount' for x in names)} AS target FROM c c0 {joins} WHERE c0.n <= 40"


SUBSETS = f"""{LINK},
c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY week ORDER BY amount, bank_id) AS i, COUNT(*) OVER (PARTITION BY week) AS n
  FROM (SELECT bank_id, amount, CAST(date_trunc('week', credited) AS DATE) AS week FROM orph) x),
t AS (SELECT a.week, a.n, a.bank_id AS target_id, a.amount + z.amount AS target FROM c a JOIN c z ON z.week = a.week AND z.i = a.i + 1),
whole AS (SELECT week, CAST(SUM(amount) AS BIGINT) AS target, list(bank_id) AS m FROM c WHERE n <= 40 GROUP BY week),
sets AS ({" UNION ALL ".join(_joined(n) for n in range(2, 6))}),
hit AS (SELECT target_id, m, COUNT(*) OVER (PARTITION BY target_id) AS hits FROM t JOIN sets USING (week, target) WHERE (week, target) NOT IN (SELECT (week, target) FROM whole)
  UNION ALL SELECT target_id, m, 1 FROM t JOIN whole USING (week, target))
SELECT DISTINCT target_id, CASE WHEN hits = 1 THEN 'unique' ELSE 'ambiguous' END AS status, unnest(m) AS bank_id FROM hit
UNION ALL SELECT target_id, 'too_large', NULL FROM t WHERE n > 40"""

UNITS = f"""{LINK},
u0 AS (SELECT i.k, i.seller, i.category, i.placed, i.gross, i.applied_bps, i.tcs, i.tds, c.bps AS card_bps, COALESCE(p.n, 0) AS n_payments, COALESCE(p.fee, 0) AS fee, COALESCE(p.tax, 0) AS tax, COALESCE(p.gst, 0) AS fee_gst,
    COALESCE(r.n, 0) AS n_refunds, COALESCE(r.amount, 0) AS refunds, COALESCE(d.amount, 0) AS disputes, COALESCE(h.n, 0) AS n_orphaned, COALESCE(h.amount, 0) AS orphaned,
    COALESCE(v.n, 0) AS n_reversals, COALESCE(v.amount, 0) AS reversals, COALESCE(s.n, 0) AS n_recons, COALESCE(s.credit, 0) AS credit, COALESCE(s.debit, 0) AS debit, k2.k IS NOT NULL AS has_bank
  FROM intent i
  LEFT JOIN rate_card c ON c.seller = i.seller AND c.category = i.category AND i.placed >= c.eff_from AND (c.eff_to IS NULL OR i.placed <= c.eff_to)
  LEFT JOIN (SELECT order_id AS k, COUNT(*) AS n, CAST(SUM(fee) AS BIGINT) AS fee, CAST(SUM(tax) AS BIGINT) AS tax, CAST(SUM({b("fee", 1800)}) AS BIGINT) AS gst FROM payment GROUP BY 1) p ON p.k = i.k
  LEFT JOIN (SELECT payment_id AS k, COUNT(*) AS n, CAST(SUM(amount) AS BIGINT) AS amount FROM refund GROUP BY 1) r ON r.k = i.k
  LEFT JOIN (SELECT payment_id AS k, CAST(SUM(deducted) AS BIGINT) AS amount FROM dispute GROUP BY 1) d ON d.k = i.k
  LEFT JOIN (SELECT payment_id AS k, COUNT(*) AS n, CAST(SUM(amount) AS BIGINT) AS amount FROM transfer WHERE on_hold AND hold_until IS NULL GROUP BY 1) h ON h.k = i.k
  LEFT JOIN (SELECT transfer_id AS k, COUNT(*) AS n, CAST(SUM(amount) AS BIGINT) AS amount FROM reversal GROUP BY 1) v ON v.k = i.k
  LEFT JOIN (SELECT transfer_id AS k, COUNT(*) AS n, CAST(SUM(credit) AS BIGINT) AS credit, CAST(SUM(debit) AS BIGINT) AS debit FROM recon GROUP BY 1) s ON s.k = i.k
  LEFT JOIN banked k2 ON k2.k = i.k),
u1 AS (SELECT *, CASE WHEN n_payments = 0 THEN 'intent_only' WHEN has_bank THEN 'full' WHEN n_recons > 0 THEN 'missing_bank' ELSE 'missing_settlement' END AS completeness,
    gross - {b("gross", "COALESCE(card_bps, applied_bps)")} - fee AS et FROM u0),
u AS (SELECT *, et - LEAST(refunds + disputes, et) AS expected, credit - debit AS actual,
    LEAST(disputes, et) + GREATEST(0, LEAST(refunds, et - LEAST(disputes, et))) AS netting FROM u1)"""

# requires, applies, fires, amount of each check
CHECKS = {
    "D01": ("TRUE", "card_bps IS NOT NULL", f"card_bps <> applied_bps AND ABS({b('gross', 'applied_bps')} - {b('gross', 'card_bps')}) > 0", f"ABS({b('gross', 'applied_bps')} - {b('gross', 'card_bps')})"),
    "D02": ("completeness IN ('full', 'missing_bank')", "n_recons > 0", f"expected - actual > 0 AND ABS(expected - actual) <= GREATEST(100, {b('ABS(expected)', 10)})", "expected - actual"),
    "D03": ("completeness IN ('full', 'missing_bank')", "n_recons > 0 AND n_refunds > 0", "netting - debit > 0", "netting - debit"),
    "D04": ("TRUE", "TRUE", f"tcs <> {b('gross - refunds', 50)}", f"ABS(tcs - {b('gross - refunds', 50)})"),
    "D05": ("TRUE", "TRUE", f"tds <> {b('gross', 10)}", f"ABS(tds - {b('gross', 10)})"),
    "D06": ("completeness = 'missing_settlement'", "n_orphaned > 0", f"DATE '{AS_OF}' - placed >= 14", "orphaned"),
    "D07": ("completeness IN ('full', 'missing_bank')", "n_reversals > 0", "n_refunds = 0", "reversals"),
    "D08": ("completeness <> 'intent_only'", "n_payments > 0", "tax <> fee_gst", "ABS(tax - fee_gst)"),
}
SEVERITY = "CASE WHEN amount >= 100000 THEN 'high' WHEN amount >= 10000 THEN 'medium' ELSE 'low' END"


def check(d: str) -> str:
    need, applies, fires, amount = CHECKS[d]
    return f"SELECT k, '{d}' AS defect, CAST({amount} AS BIGINT) AS amount FROM u WHERE ({need}) AND ({applies}) AND ({fires})"


FOUND = UNITS + ",\nf AS (" + "\nUNION ALL ".join(check(d) for d in CHECKS) + ")"
SKIPS = "\nUNION ALL ".join(
    f"SELECT '{d}' AS defect, CASE WHEN NOT ({need}) THEN 'completeness=' || completeness || ' not in requires' ELSE 'applies_to() declined' END AS reason FROM u WHERE NOT ({need}) OR NOT ({applies})"
    for d, (need, applies, _, _) in CHECKS.items()
)


def record_key(prefix: str, n: str) -> str:
    return f"'{prefix}_' || CASE WHEN length(CAST({n} AS VARCHAR)) < 5 THEN lpad(CAST({n} AS VARCHAR), 5, '0') ELSE CAST({n} AS VARCHAR) END"


QUEUE = f"""{FOUND},
q AS (SELECT 'UNMATCHED' AS origin, 0 AS source, {record_key("bank", "bank_id")} AS key, amount, 'residual: unmatched record' AS reason FROM loose
  UNION ALL SELECT 'UNMATCHED', 1, key, amount, 'ambiguous in ' || pass FROM (SELECT t.pass, t.pending_id, MIN({record_key("bank", "t.bank_id")}) AS key, arg_min(amount, {record_key("bank", "t.bank_id")}) AS amount FROM tied t JOIN bank USING (bank_id) GROUP BY 1, 2)
  UNION ALL SELECT 'FINDING', 2, defect || '/' || {record_key("ord", "k")}, amount, defect FROM f),
queue AS (SELECT origin, key, amount, reason, ROW_NUMBER() OVER (ORDER BY amount DESC, key, source, reason) AS rank FROM q)"""

# The reference numbers that bank narrations carry, as in functions/text.py.
UTR = [
    ("utr_labelled", r"\bUTR[:\s-]*([A-Z0-9]{12,22})\b", 10000), ("neft_ref", r"\bNEFT[/\s-]*([A-Z]{4}[A-Z0-9]{8,18})\b", 9500),
    ("rtgs_ref", r"\bRTGS[/\s-]*([A-Z0-9]{16,22})\b", 9500), ("imps_ref", r"\bIMPS[/\s-]*(\d{12})\b", 9000), ("bare_token", r"\b([A-Z]{4}[A-Z0-9]{12,18})\b", 6000),
]
_HITS = ", ".join(f"list_distinct(regexp_extract_all(narration, '{p}', 1)) AS h{i}" for i, (_, p, _) in enumerate(UTR))


def _utr(of) -> str:
    return "CASE " + " ".join(f"WHEN len(h{i}) > 0 THEN {of(i, n, c)}" for i, (n, _, c) in enumerate(UTR))


EXTRACT = f"""SELECT bank_id, {_utr(lambda i, n, c: f"CASE WHEN len(h{i}) = 1 THEN h{i}[1] END")} END AS utr,
  CAST({_utr(lambda i, n, c: f"CASE WHEN len(h{i}) = 1 THEN {c} ELSE 0 END")} ELSE 0 END AS BIGINT) AS confidence_bps,
  {_utr(lambda i, n, c: f"CASE WHEN len(h{i}) = 1 THEN '{n}' ELSE 'ambiguous_narration' END")} ELSE 'no_match' END AS pattern
FROM (SELECT bank_id, {_HITS} FROM narration)"""
