"""From files to a committed run: a run that is lost midway goes on, and ends as one that was not."""

import pytest

from assure.plans import ingest, source_files
from assure.plans.projection import Records
from assure.sources.shared import stamp


class Lost(Exception):
    pass


def test_a_lost_run_goes_on(spark, sf, tmp_path):
    files, run, other = (f"file://{tmp_path}/{n}" for n in ("files", "run", "other"))
    source_files.write(Records(spark, sf), files)
    done = []

    def lose(stage, table):
        done.append(table)
        if table == "match_group":
            raise Lost

    with pytest.raises(Lost):
        ingest.commit_from_files(spark, files, run, after=lose)
    with pytest.raises(Exception):
        ingest.summary(spark, run)  # no manifest, no run
    before = {t: stamp(spark, f"{run}/{t}") for t in done}
    half = tmp_path / "run" / "match_member"
    half.mkdir()
    (half / "part-0").write_text("half")
    manifest = ingest.commit_from_files(spark, files, run)
    assert before == {t: stamp(spark, f"{run}/{t}") for t in done}
    assert manifest["digests"] == ingest.commit_from_files(spark, files, other)["digests"] and len(manifest["tables"]) > 20
    assert all(d["rows"] for t, d in manifest["digests"].items() if t not in ("quarantine",))
    with pytest.raises(ingest.InputsChanged):
        ingest.commit_from_files(spark, files, run, label="IN_SAMPLE")


def test_tied_credits_go_by_their_references(spark, tmp_path):
    """The first of tied credits is that of the least reference as text, though its line comes later."""
    from assure.operators.linking import Linked

    bank = spark.createDataFrame([(1, 100, "bank_99999"), (2, 200, "bank_100000"), (3, 300, "bank_7")], "bank_id long, amount long, bank_ref string")
    run = ingest.FileRun(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/run")
    run.t = lambda name: {"bank": bank}[name]
    tied = spark.createDataFrame([("P3", 5, 1), ("P3", 5, 2), ("P3", 6, 1), ("P3", 6, 3)], "pass string, pending_id long, bank_id long")
    run.linked = Linked(None, tied, bank.select("bank_id").limit(0))
    run.findings = spark.createDataFrame([], "k long, defect string, amount long")
    assert [(r["key"], r["amount"]) for r in run.queue.orderBy("rank").collect()] == [("bank_00003", 300), ("bank_00002", 200)]
