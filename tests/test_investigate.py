"""Rounds of investigations against a loop that takes one exception after the other; recorded and replayed answers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from assure.operators import resolutions, tools
from assure.plans import investigate as plan
from assure.sources import replay

DAY = dt.date(2026, 1, 5)


class Small:
    """Canonical tables of a few rows."""

    def __init__(self, spark):
        rows = {
            "intent": ("k long, seller long, gross long", [(1, 5, 100), (2, 5, 200), (3, 6, 300)]),
            "payment": ("payment_id long, order_id long, amount long", [(1, 1, 100), (2, 2, 200), (3, None, 7)]),
            "transfer": ("transfer_id long, payment_id long, amount long", [(1, 1, 90), (2, 2, 180)]),
            "refund": ("refund_id long, payment_id long, amount long", [(1, 1, 10), (2, 1, 20)]),
            "dispute": ("dispute_id long, payment_id long, amount long", [(2, 2, 50)]),
            "recon": ("recon_id long, transfer_id long, settled date", [(1, 1, DAY), (2, 2, DAY), (3, None, None)]),
            "rate_card": ("seller long, category string, bps long, eff_from date, eff_to date, ver int", [(5, "A", 1, dt.date(2025, 1, 1), dt.date(2025, 12, 31), 1), (5, "A", 2, dt.date(2026, 1, 1), None, 2), (6, None, 3, dt.date(2026, 6, 1), None, 1)]),
        }
        self.made = {n: spark.createDataFrame(r, s) for n, (s, r) in rows.items()}

    def table(self, name):
        return self.made[name]


def looked_up(tool, args):
    """The refs that a call gives, or None where it fails."""
    args = {k: v for k, v in (args or {}).items() if v is not None}
    if tool not in tools.ARGUMENTS or not set(args) <= set(tools.ARGUMENTS[tool]):
        return None
    if tool == tools.SEARCH:
        intents = {"int_00001": ("ord_00001", "sell_00005"), "int_00002": ("ord_00002", "sell_00005"), "int_00003": ("ord_00003", "sell_00006")}
        return [k for k, (o, s) in intents.items() if args.get("order_id", o) == o and args.get("seller_id", s) == s] if args else None
    if set(args) != set(tools.ARGUMENTS[tool]):
        return None
    one = {"fetch_payment": {f"pay_0000{i}": [f"pay_0000{i}"] for i in (1, 2, 3)}, "fetch_transfer": {f"trf_0000{i}": [f"trf_0000{i}"] for i in (1, 2)}, "fetch_dispute": {"disp_00002": ["disp_00002"]},
           "fetch_refunds_for_payment": {"pay_00001": ["rfnd_00001", "rfnd_00002"], "pay_00002": [], "pay_00003": []}}
    if tool in one:
        return one[tool].get(next(iter(args.values())))
    if tool == "fetch_settlement_recon":
        return ["rcn_00001", "rcn_00002"] if args["date"] == str(DAY) else []
    cards = {"sell_00005": [("card_00005/A/1", "2025-01-01", "2025-12-31"), ("card_00005/A/2", "2026-01-01", "9999")], "sell_00006": [("card_00006//1", "2026-06-01", "9999")]}.get(args["seller_id"])
    if cards is None:
        return None
    return [r for r, a, b in cards if a <= args["as_of"] <= b] if args["as_of"][:2] == "20" else []


def plain_loop(exc, script, limits):
    key, tokens, tried, gathered = exc["key"], 0, [], []
    for n in range(limits.rounds):
        if limits.budget - tokens < limits.reserve:
            return "budget_exhausted", n, tokens, tried, gathered, None
        a = script[key][n]
        tokens += (a["tokens_in"] or 0) + (a["tokens_out"] or 0)
        s = a["submit"]
        if s is not None:
            hyps, ev = s["hypotheses"] or [], s["evidence"] or []
            good = s["outcome"] in ("AUTO_RESOLVED", "PROPOSED", "ESCALATED_UNRESOLVED") and not (s["outcome"] == "ESCALATED_UNRESOLVED" and not s["resolve"])
            good = good and (s["trivial"] or len(hyps) > 1) and (s["chosen"] is None or 0 <= s["chosen"] < len(hyps)) and ev and s["confidence_bps"] is not None and 0 <= s["confidence_bps"] <= 10_000
            if good:
                return "sufficient_evidence", n + 1, tokens, tried, gathered, s
            continue
        for c in a["calls"] or []:
            tried.append(c)
            gathered += [r for r in looked_up(c["name"], c["args"]) or [] if r not in gathered]
    return "iteration_cap", limits.rounds, tokens, tried, gathered, None


def random_answer(rng):
    def call():
        name = rng.choice([*tools.ARGUMENTS, "fetch_nothing"])
        values = {"payment_id": ["pay_00001", "pay_00002", "pay_00009"], "transfer_id": ["trf_00001", "trf_00007"], "dispute_id": ["disp_00002", "disp_1"], "date": [str(DAY), "2020-01-01", "x"],
                  "as_of": ["2025-03-01", "2026-03-01", "2026-07-01", "soon"], "seller_id": ["sell_00005", "sell_00006", "sell_00009"], "order_id": ["ord_00001", "ord_00003", "ord_00008"]}
        names = [n for n in tools.ARGUMENTS.get(name, ()) if rng.random() < 0.85] + (["extra"] if rng.random() < 0.05 else [])
        return {"name": name, "args": {n: rng.choice(values.get(n, ["1"])) if rng.random() < 0.95 else None for n in names}}

    submit = None
    if rng.random() < 0.3:
        submit = {"outcome": rng.choice(["PROPOSED", "AUTO_RESOLVED", "ESCALATED_UNRESOLVED", "DONE"]), "confidence_bps": rng.choice([0, 9000, 10_001, None]), "hypotheses": rng.choice([None, ["a"], ["a", "b"]]),
                  "chosen": rng.choice([None, 0, 1, 2]), "evidence": rng.choice([None, [{"ref": "pay_00001", "role": "payment"}]]), "tried": "t", "resolve": rng.choice([None, "", "more"]), "trivial": rng.random() < 0.5}
    calls = None if rng.random() < 0.1 else [call() for _ in range(rng.randrange(4))]
    return {"text": rng.choice(["", "hm", None]), "calls": calls, "submit": submit, "tokens_in": rng.choice([None, 100, 9_000]), "tokens_out": rng.choice([10, 1_000])}


def setup(spark, seed, n):
    rng = random.Random(seed)
    excs = [{"rank": i, "origin": "FINDING" if i % 2 else "UNMATCHED", "key": f"D01/ord_{i:05}" if i % 2 else f"bank_{i:05}", "amount": i * 10, "reason": "r", "record_key": None if i % 2 else f"bank_{i:05}"} for i in range(1, n + 1)]
    script = {e["key"]: [random_answer(rng) for _ in range(8)] for e in excs}
    table = spark.createDataFrame([(k, t + 1, a) for k, answers in script.items() for t, a in enumerate(answers)], f"key string, turn int, response {replay.RESPONSE}")
    exceptions = spark.createDataFrame([tuple(e.values()) for e in excs], "rank long, origin string, key string, amount long, reason string, record_key string")
    cites = exceptions.where("origin = 'FINDING'").select("rank", F.expr("substr(key, 5)").alias("ref"))
    return excs, script, table, exceptions, cites


def test_rounds_are_the_loop(spark):
    excs, script, table, exceptions, cites = setup(spark, 7, 60)
    limits = plan.Limits(budget=40_000)
    found = plan.investigate(exceptions, cites, tools.Evidence(Small(spark)), replay.scripted(table), limits=limits)
    got = {r["rank"]: r for r in found.resolutions.collect()}
    evidence, calls = {}, {}
    sizes = {r["rank"]: r["evidence"] for r in found.gathered.collect()}
    for r in found.evidence.collect():
        evidence.setdefault(r["rank"], set()).add(r["ref"])
    for r in found.calls.collect():
        calls.setdefault(r["rank"], []).append(r)
    assert len(got) == len(excs) == found.resolutions.count()
    stops = set()
    for e in excs:
        stop, rounds, tokens, tried, gathered, s = plain_loop(e, script, limits)
        r = got[e["rank"]]
        stops.add(stop)
        assert (r["stop_reason"], r["iterations"], r["tokens"], r["amount"]) == (stop, rounds, tokens, e["amount"])
        assert evidence.get(e["rank"], set()) == set(gathered)
        assert sizes.get(e["rank"], 0) == len(gathered)
        mine = calls[e["rank"]]
        assert sum(c["tokens_in"] + c["tokens_out"] for c in mine) == tokens and len(mine) == rounds + len(tried)
        assert sum(c["error"] is not None for c in mine) == sum(looked_up(c["name"], c["args"]) is None for c in tried)
        if s is None:
            own = [e["key"][4:]] if e["origin"] == "FINDING" else [e["key"]]
            assert r["outcome"] == "ESCALATED_UNRESOLVED" and r["refs"] == (sorted(gathered) or own) and r["resolve"] == resolutions.HINTS[stop]
            assert r["tried"].count("(") == max(1, len(tried)) or not tried
        else:
            assert (r["outcome"], r["confidence_bps"], r["chosen"]) == (s["outcome"], s["confidence_bps"], s["chosen"])
    assert stops == {"sufficient_evidence", "iteration_cap", "budget_exhausted"}


def test_record_then_replay(spark, tmp_path):
    _, _, table, exceptions, cites = setup(spark, 11, 12)
    evidence, store = tools.Evidence(Small(spark)), f"file://{tmp_path}/answers"
    rows = lambda client, m="m": sorted(map(repr, plan.investigate(exceptions, cites, evidence, client, "p", m).resolutions.collect()))
    first = rows(replay.recorded(spark, store, replay.scripted(table)))
    kept = spark.read.parquet(store).count()
    assert first == rows(replay.replayed(spark, store)) == rows(replay.recorded(spark, store, replay.scripted(table.limit(0))))
    assert kept == spark.read.parquet(store).count()
    with pytest.raises(replay.NoAnswer):
        rows(replay.replayed(spark, store), "another model")
    with pytest.raises(replay.NoAnswer):
        rows(replay.replayed(spark, f"file://{tmp_path}/none"))


def test_nothing_open(spark):
    _, _, table, exceptions, cites = setup(spark, 1, 1)
    found = plan.investigate(exceptions.limit(0), cites, tools.Evidence(Small(spark)), replay.scripted(table))
    assert found.resolutions.count() == found.calls.count() == found.evidence.count() == 0


def test_prompt_hash():
    assert replay.prompt_hash({"b": "2", "a": "1"}) == replay.prompt_hash({"a": "1", "b": "2"}) != replay.prompt_hash({"a": "12", "b": ""})


def test_lookups_read_rows_of_their_kind_only(spark, monkeypatch):
    made, write = [], tools.written
    monkeypatch.setattr(tools, "written", lambda df: made.append({r["tool"] for r in df.select("tool").distinct().collect()}) or write(df))
    evidence = tools.Evidence(Small(spark))
    calls = spark.createDataFrame([(1, 1, 1, "fetch_payment", {"payment_id": "pay_00001"}), (1, 1, 2, "no_such_tool", {})], "rank long, turn int, pos int, tool string, args map<string,string>")
    answered = evidence.answers(calls)
    evidence.gathered(answered, "rank").collect()
    assert made == [{"fetch_payment"}]


def test_the_script_is_made_once(spark):
    """Each round reads the answers that were written, whatever it took to make them."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    table = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "key string, turn int").mapInArrow(counted, "key string, turn int")
    client = replay.scripted(table.select("key", "turn", F.from_json(F.concat(F.lit('{"text": "'), "key", F.lit('"}')), replay.RESPONSE).alias("response")))
    for turn, keys in ((1, {"a", "b"}), (2, {"a"})):
        asked = spark.createDataFrame([(k, turn) for k in ("a", "b")], "key string, turn int")
        assert {r["key"]: r["response"]["text"] for r in client(asked).where("response IS NOT NULL").collect()} == {k: k for k in keys}
    assert made.value == 3
