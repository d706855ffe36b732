"""Investigations of all open exceptions at once: a round asks for each, runs the tools that were called, and ends those that are done."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assure.operators import resolutions
from assure.operators.tools import Evidence
from assure.sources.replay import Client, NoAnswer, request_key
from assure.sources.shared import written


@dataclass(frozen=True)
class Limits:
    """Rounds for an exception; its tokens, and those that must be left for another round."""

    rounds: int = 8
    budget: int = 60_000
    reserve: int = 4_000


@dataclass(frozen=True)
class Investigation:
    """resolutions: a row an exception; calls: a row a turn (pos 0) and a tool call (pos from 1); gathered: rank, evidence (records).

    evidence: rank, ref, role, first. A day's rows that many exceptions asked for are in it once for each: made only where it is used.
    """

    resolutions: DataFrame
    calls: DataFrame
    gathered: DataFrame
    evidence: DataFrame


NUDGE = "call a tool or submit_resolution"


def _broken():
    """Names of the invariants that a submission breaks, as an array."""
    s = F.col("response.submit")
    judged = F.struct(
        s["outcome"].alias("outcome"), s["confidence_bps"].alias("confidence_bps"), F.coalesce(F.size(s["hypotheses"]), F.lit(0)).alias("n_hypotheses"), s["chosen"].alias("chosen"),
        F.coalesce(F.size(s["evidence"]), F.lit(0)).alias("n_evidence"), s["resolve"].alias("resolve"), F.coalesce(s["trivial"], F.lit(False)).alias("trivial"),
    )
    known = F.coalesce(s["outcome"].isin("AUTO_RESOLVED", "PROPOSED", "ESCALATED_UNRESOLVED"), F.lit(False))
    return F.concat(resolutions.broken(judged), F.when(known, F.array().cast("array<string>")).otherwise(F.array(F.lit("outcome"))))


def investigate(exceptions: DataFrame, of_findings: DataFrame, tools: Evidence, client: Client, prompt: str = "", model: str = "scripted", limits: Limits = Limits()) -> Investigation:
    """exceptions: rank (unique), origin, key, amount, reason, record_key; of_findings: rank, ref that the finding cites.

    All that was said is held as a digest, so a row of the state stays small however long the talk. A round writes what was answered
    and what the tools gave to the shared folder; a request without an answer raises NoAnswer. A submission that breaks an invariant
    is told so and goes on; a turn without calls is nudged. The amount is always the exception's own. An exception that the cap of
    rounds or its budget stops is escalated and cites what was gathered, else its finding's records, else its own.
    """
    start = F.sha2(F.to_json(F.struct("origin", "key", "amount", "reason")), 256)
    state = exceptions.select("rank", "key", "amount", F.lit(0).cast("long").alias("tokens"), start.alias("transcript"))
    ended: list[DataFrame] = []
    stopped: list[DataFrame] = []
    turns: list[DataFrame] = []
    tool_calls: list[DataFrame] = []
    for turn in range(1, limits.rounds + 1):
        enough = F.lit(limits.budget) - F.col("tokens") >= limits.reserve
        stopped.append(state.where(~enough).select("rank", F.lit("budget_exhausted").alias("stop_reason"), F.lit(turn - 1).alias("iterations"), "tokens"))
        requests = state.where(enough).withColumns({"turn": F.lit(turn), "request": request_key(prompt, model, "transcript")})
        answered = written(client(requests).withColumn("broken", F.when(F.col("response.submit").isNotNull(), _broken())))
        n, got = answered.agg(F.count("*"), F.count("response")).head()
        if got < n:
            lost = [f"{r['key']} turn {turn}: {r['request']}" for r in answered.where("response IS NULL").limit(3).collect()]
            raise NoAnswer("; ".join(lost))
        if not n:
            state = state.limit(0)
            break
        r = F.col("response")
        spent = F.col("tokens") + F.coalesce(r["tokens_in"], F.lit(0)) + F.coalesce(r["tokens_out"], F.lit(0))
        answered = answered.withColumn("tokens", spent)
        n_calls = F.coalesce(F.size(r["calls"]), F.lit(0))
        turns.append(answered.select(
            "rank", F.lit(turn).alias("turn"), F.lit(0).alias("pos"), F.when(r["submit"].isNotNull(), "submit_resolution").otherwise("model_turn").alias("tool"), F.lit("{}").alias("args"),
            F.sha2(F.coalesce(r["text"], F.lit("")), 256).alias("digest"), n_calls.cast("long").alias("n_rows"), F.lit(None).cast("string").alias("error"),
            F.coalesce(r["tokens_in"], F.lit(0)).cast("long").alias("tokens_in"), F.coalesce(r["tokens_out"], F.lit(0)).cast("long").alias("tokens_out"),
        ))
        s = r["submit"]
        ended.append(answered.where("size(broken) = 0").select(
            "rank", "key", "amount", s["outcome"].alias("outcome"), s["confidence_bps"].alias("confidence_bps"), F.coalesce(F.size(s["hypotheses"]), F.lit(0)).alias("n_hypotheses"), s["chosen"].alias("chosen"),
            F.coalesce(s["tried"], F.lit("")).alias("tried"), s["resolve"].alias("resolve"), F.coalesce(s["trivial"], F.lit(False)).alias("trivial"), F.lit("sufficient_evidence").alias("stop_reason"),
            F.lit(turn).alias("iterations"), "tokens", F.transform(s["evidence"], lambda e: e["ref"]).alias("refs"),
        ))
        open_ = answered.where("broken IS NULL OR size(broken) > 0")
        asked = open_.where("broken IS NULL").select("rank", F.posexplode("response.calls").alias("pos", "c"))
        asked = asked.select("rank", F.lit(turn).alias("turn"), (F.col("pos") + 1).alias("pos"), F.col("c.name").alias("tool"), F.col("c.args").alias("args"))
        results = written(tools.answers(asked))
        tool_calls.append(results)
        said = results.groupBy("rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"]), ",").alias("said"))
        said_or = F.coalesce(F.col("said"), F.when(F.col("broken").isNotNull(), F.concat(F.lit("rejected: "), F.array_join("broken", ","))).otherwise(NUDGE))
        state = open_.join(said, "rank", "left").select("rank", "key", "amount", "tokens", F.sha2(F.concat_ws("\n", "transcript", F.to_json("response"), said_or), 256).alias("transcript"))
    stopped.append(state.select("rank", F.lit("iteration_cap").alias("stop_reason"), F.lit(limits.rounds).alias("iterations"), "tokens"))

    every = reduce(DataFrame.unionByName, tool_calls) if tool_calls else None
    if every is None:
        every = tools.answers(exceptions.limit(0).select("rank", F.lit(0).alias("turn"), F.lit(0).alias("pos"), F.lit("").alias("tool"), F.create_map().cast("map<string,string>").alias("args")))
    evidence = tools.refs(every, "rank")
    cut = written(reduce(DataFrame.unionByName, stopped))
    theirs = every.join(cut.select("rank"), "rank", "left_semi")
    forced = _forced(exceptions.join(cut, "rank"), of_findings, theirs, tools.refs(theirs, "rank"))
    log = every.select("rank", "turn", "pos", "tool", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("args")))).alias("args"), "digest", "n_rows", "error", F.lit(0).cast("long").alias("tokens_in"), F.lit(0).cast("long").alias("tokens_out"))
    return Investigation(reduce(DataFrame.unionByName, [*ended, forced]), reduce(DataFrame.unionByName, [*turns, log]), tools.gathered(every, "rank"), evidence)


def _forced(cut: DataFrame, of_findings: DataFrame, calls: DataFrame, evidence: DataFrame) -> DataFrame:
    """The escalation of each exception that was stopped: what was tried in order of the calls, and what grounds it."""
    subjects = cut.select(F.col("rank").alias("key"), "origin", "record_key")
    own = of_findings.select(F.col("rank").alias("key"), "ref").join(subjects.select("key"), "key", "left_semi")
    grounds = resolutions.grounded(subjects, evidence.select(F.col("rank").alias("key"), "ref"), own).select(F.col("key").alias("rank"), "refs")
    text = F.concat(F.coalesce("tool", F.lit("")), F.lit("("), F.array_join(F.transform(F.array_sort(F.map_entries("args")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ", "), F.lit(")"))
    tried = calls.groupBy("rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "pos", text.alias("t")))), lambda x: x["t"]), "; ").alias("did"))
    hints = F.create_map(*[F.lit(x) for kv in resolutions.HINTS.items() for x in kv])
    return cut.join(tried, "rank", "left").join(grounds, "rank", "left").select(
        "rank", "key", "amount", F.lit("ESCALATED_UNRESOLVED").alias("outcome"), F.lit(0).alias("confidence_bps"), F.lit(1).alias("n_hypotheses"), F.lit(None).cast("int").alias("chosen"),
        F.coalesce("did", F.lit(resolutions.NOTHING_TRIED)).alias("tried"), hints[F.col("stop_reason")].alias("resolve"), F.lit(True).alias("trivial"), "stop_reason", "iterations", "tokens", "refs",
    )
