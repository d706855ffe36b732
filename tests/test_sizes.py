"""What one task holds doesn't grow with the tables: more of them make more tasks."""

import datetime as dt
import os

from pyspark.sql import functions as F

from assure.operators import linking
from assure.plans.projection import Records
from assure.queries import QUERIES
from assure.sources import shared


def test_tasks_follow_the_size_of_the_tables(spark, tmp_path, monkeypatch):
    names = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        (tmp_path / "small").write_bytes(b"x")
        (tmp_path / "large").write_bytes(b"")
        os.truncate(tmp_path / "large", 100 * shared.PART)
        shared.small_tasks(spark, [f"file://{tmp_path}/small"])
        least = shared.partitions(spark)
        shared.small_tasks(spark, [f"file://{tmp_path}/large"])
        assert shared.partitions(spark) == max(least, 100)
        assert int(spark.conf.get(names[1])) <= shared.READ and int(spark.conf.get(names[2])) <= shared.SHUFFLED
        shared.small_tasks(spark, [f"file://{tmp_path}/small"])
        assert shared.partitions(spark) == max(least, 100)  # never fewer
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_many_rows_in_small_files_are_not_sent_whole(spark, tmp_path):
    """Written tables are taken to be as large as their compressed files; joins with them hold no more in the driver as they grow."""
    (tmp_path / "small").write_bytes(b"x")
    shared.small_tasks(spark, [f"file://{tmp_path}/small"])
    groups = shared.written(spark.range(3_000_000).selectExpr("id AS component", "CONCAT('match_', LPAD(id, 7, '0')) AS match_id"), f"file://{tmp_path}/groups")
    assert sum(f.stat().st_size for f in (tmp_path / "groups").iterdir()) < 10 << 20  # Spark's limit, for 100 MB of rows
    members = groups.select((F.col("component") * 7).alias("component")).join(groups, "component")
    assert "Broadcast" not in members._jdf.queryExecution().sparkPlan().toString()
    assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == str(shared.SENT_ROWS)


def test_pairs_are_made_once(spark, tmp_path):
    """Claims, ties and leftovers of a pass read its pairs, and don't make them again."""
    pairs = spark.createDataFrame([(1, 10), (2, 20), (2, 21)], "pending_id long, bank_id long")
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    p, b = (spark.createDataFrame([(n,) for n in ns], f"{c} long") for c, ns in (("pending_id", (1, 2, 3)), ("bank_id", (10, 20, 21, 30))))
    a = linking.attach(p, b, pairs.mapInArrow(counted, pairs.schema))
    got = [sorted(map(tuple, df.collect())) for df in (a.claimed, a.tied, a.pending, a.banks)]
    assert got == [[(1, 10)], [(2, 20), (2, 21)], [(3,)], [(30,)]]
    assert made.value == 3


def test_alike_chains_and_credits_are_met_once(spark, monkeypatch):
    """n chains and m credits of one amount and day are one pair of values in every pass; claims, ties and leftovers are those of the pairs."""
    day = dt.date(2026, 7, 1)
    chains = [(i, 50_000, i, day) for i in range(30)] + [(100, 70_000, 100, day), (101, 90_000, 101, day)] + [(200 + i, 40_000_000, 200 + i, day) for i in range(30)]
    credits = [(i, 50_000, day) for i in range(1000, 1040)] + [(1100, 70_000, day), (1101, 90_010, day), (1102, 5, day)] + [(1200 + i, 40_000_100, day) for i in range(40)]
    p = spark.createDataFrame(chains, "pending_id long, target_paise long, settlement_id long, settled date")
    b = spark.createDataFrame(credits, "bank_id long, amount long, credited date")
    sizes, write = [], linking.written
    monkeypatch.setattr(linking, "written", lambda df: (made := write(df), sizes.append(made.count()))[0])
    got = linking.link(p, b)
    claims = {tuple(r) for r in got.groups.where("bank_id IS NOT NULL").select("pending_id", "pass", "bank_id").collect()}
    first = {(r["pass"], r["pending_id"]): r["first"]["key"] for r in got.torn.collect()}
    assert max(sizes) < 10
    assert claims == {(100, "P1", 1100), (101, "P3", 1101)}
    assert first == {("P1", i): "bank_01000" for i in range(30)} | {("P3", 200 + i): "bank_01200" for i in range(30)}
    assert {tuple(r) for r in got.ambiguous.select("pass", "pending_id", "bank_id").collect()} == {("P1", c, k) for c in range(30) for k in range(1000, 1040)} | {("P3", 200 + c, 1200 + k) for c in range(30) for k in range(40)}
    assert {r["bank_id"] for r in got.unmatched_banks.collect()} == {k for k, *_ in credits} - {1100, 1101}


def test_values_are_parsed_once(spark, sf):
    """The detail of a quarantined row and its columns read one parse of each value, in one pass over the rows."""
    plan = QUERIES["ingest_quarantine_split"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and plan.count("gettimestamp(") == 1


def test_findings_are_evaluated_once(spark, sf):
    """Readers of the findings read what is written down: no check is evaluated again."""
    plan = QUERIES["findings_all"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "gross" not in plan


def test_lines_are_summed_once(spark, sf):
    """The pairs of sellers and categories are read off the written intent, not off lines summed and joined again."""
    plan = Records(spark, sf).table("rate_card")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_members_are_shuffled_once(spark):
    rows = [(1, 4, "intent", None, None, None, None), (1, 5, "razorpay", None, None, None, None), (1, 6, "razorpay", 900, 100, 1, None), (2, 8, "intent", None, None, None, None)]
    rows += [(3, 12, "razorpay", 50, 0, 3, None), (3, 15, "bank", None, None, None, None), (4, 16, "intent", None, None, None, None), (4, 17, "razorpay", None, None, None, None)]
    made = linking.route(spark.createDataFrame(rows, "component long, ord long, side string, credit long, debit long, settlement_id long, settled date"))
    assert {(r["component"], r["kind"], r["target_paise"]) for r in made.collect()} == {(1, "pending", 800), (2, "remaining", 0), (3, "group", 50), (4, "group", 0)}
    assert made._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 2  # before and after one shuffle
