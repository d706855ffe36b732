"""Workload, scorer, run store, gates and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from assure.operators import constraints, triage
from assure.plans import close, runstore, score, synth
from assure.streaming import pending


def test_clean_workload_has_no_findings(spark):
    assert synth.found_in(synth.world(spark, synth.tiered("T4", orders=300))).count() == 0


def test_injected_defects_are_found_and_nothing_else(spark):
    rows = synth.world(spark, synth.tiered("T2", orders=500))
    want = {(r["id"], r["defect"]) for r in rows.where("defect is not null").collect()}
    assert want and {(r["id"], r["found"]) for r in synth.found_in(rows).collect()} == want


def test_workload_is_the_same_for_any_partitioning(spark):
    w = synth.Workload(orders=200)
    a = synth.world(spark, w).agg(F.sum(F.xxhash64("id", "gross_paise", "utr").cast("decimal(38,0)"))).head()[0]
    assert a == synth.world(spark, w).repartition(7).agg(F.sum(F.xxhash64("id", "gross_paise", "utr").cast("decimal(38,0)"))).head()[0]
    assert a != synth.world(spark, synth.Workload(orders=200, seed=7)).agg(F.sum(F.xxhash64("id", "gross_paise", "utr").cast("decimal(38,0)"))).head()[0]


def test_defects_prefer_their_own_class(spark):
    injected = spark.createDataFrame([("i1", 1, "D01", 500), ("i2", 2, "D02", 300), ("i3", 3, "D03", 700)], "instance string, order long, defect string, paise long")
    findings = spark.createDataFrame([("f1", 1, "D05"), ("f2", 1, "D01"), ("f3", 2, "D05")], "finding_id string, order long, found string")
    got = {r["instance"]: (r["detected"], r["class_correct"]) for r in score.scored_defects(injected, findings).collect()}
    assert got == {"i1": (True, True), "i2": (True, False), "i3": (False, False)}


def test_determinism_needs_two_runs(spark):
    one = spark.createDataFrame([(1, "a", "x")], "run int, key string, hash string")
    assert score.determinism(one, 1).head()["score"] is None
    two = one.union(spark.createDataFrame([(2, "a", "x"), (1, "b", "x"), (2, "b", "y")], "run int, key string, hash string"))
    assert score.determinism(two, 2).head()["score"] == 0.5


def test_gates(spark):
    rows = spark.createDataFrame([("AUTO_RESOLVED", 9_999, 9_000), ("AUTO_RESOLVED", 10_000, 8_000), ("AUTO_RESOLVED", 5, 8_999), ("PROPOSED", 5, 0)], "outcome string, amount long, confidence_bps int")
    assert [(r["final_outcome"], r["downgrade_reason"]) for r in triage.downgraded(rows).collect()] == [("AUTO_RESOLVED", None), ("PROPOSED", "amount"), ("PROPOSED", "confidence"), ("PROPOSED", None)]
    with pytest.raises(triage.FabricationError):
        triage.assert_grounded(spark.createDataFrame([("ord_00009",)], "key string"), spark.createDataFrame([("ord_00001",)], "key string"))


def test_budget_counts_what_went_before(spark):
    rows = spark.createDataFrame([(1, 40), (2, 30), (3, 50)], "rank long, tokens long")
    assert [r["investigated"] for r in triage.within_budget(rows, 70).orderBy("rank").collect()] == [True, True, False]


def test_a_run_is_written_once_and_read_after_its_manifest(spark, tmp_path):
    run = f"file://{tmp_path}/run"
    table = spark.createDataFrame([(1, 5)], "id long, amount_paise long")
    with pytest.raises(runstore.ManifestMissing):
        runstore.opened(spark, run)
    runstore.commit(spark, run, {"finding": table}, {"sample_label": "HELD_OUT", "git_dirty": True})
    with pytest.raises(runstore.DirtyTree):
        runstore.opened(spark, run)
    assert runstore.opened(spark, run, allow_dirty=True)[1] == "PROVISIONAL"
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        runstore.commit(spark, run, {"finding": table}, {"sample_label": "HELD_OUT", "git_dirty": True})
    with pytest.raises(TypeError):
        runstore.commit(spark, run + "2", {"finding": table.withColumn("x_paise", F.lit(1.0))}, {})
    with pytest.raises(constraints.ConstraintError):
        runstore.commit(spark, run + "3", {"finding": table}, {}, (constraints.unique("twice", table.union(table), "id"),))
    runstore.export_jsonl(table, run + "-jsonl")
    assert spark.read.text(run + "-jsonl").head()[0] == '{"id":1,"amount_paise":5}'


def test_close_text(spark):
    assert "| gross | ₹1,20,000.00 |" in close.close_text(spark.createDataFrame([("gross", 12_000_000)], "measure string, paise long"))


def test_streamed_credit_meets_its_chain(spark, tmp_path):
    t = dt.datetime(2026, 7, 1)
    chains = spark.createDataFrame([("u1", t, 100), ("u2", t, 200)], "utr string, settled_at timestamp, target_paise long")
    credits = spark.createDataFrame([("u1", t + dt.timedelta(days=2), 100)], "utr string, credited_at timestamp, amount_paise long")
    chains.write.parquet(f"{tmp_path}/chains")
    credits.write.parquet(f"{tmp_path}/credits")
    met = pending.credited(
        pending.files(spark, f"{tmp_path}/chains", "utr string, settled_at timestamp, target_paise long"),
        pending.files(spark, f"{tmp_path}/credits", "utr string, credited_at timestamp, amount_paise long"),
    )
    q = met.writeStream.format("memory").queryName("met").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    assert q.awaitTermination(120)
    assert [(r["utr"], r["amount_paise"]) for r in spark.sql("SELECT * FROM met").collect()] == [("u1", 100)]
