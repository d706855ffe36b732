"""Rows without a doc_id keep their results."""

from test_llm import documents
from test_near_dedup import brute, kept, near_copies

from assure.llm import line_dedup, pii


def test_the_stage_keeps_rows_without_ids(spark):
    rows = [(None if i % 3 == 0 else r[0], *r[1:]) for i, r in enumerate(near_copies(docs=12))]
    got = kept(spark, rows)
    # which of several texts without ids stays is set by their hash: compare with ids, and count
    assert {r for r in got if r[0] is not None} == {r for r in brute(rows) if r[0] is not None}
    assert len(got) == len(brute(rows)) and any(r[0] is None for r in got)


def test_found_spans_of_rows_without_ids(spark):
    rows = [(i, f"Pay now. My account number is +1 555 000 11{k} thanks", "en", "s") for i, k in enumerate(range(10, 18))]
    rows += [(i, "So: my account number is 555 123 9876 thanks", "en", "s") for i in (50, None)] + [(None, "none here", "en", "s")]
    got = {(r["doc_id"], r["spans"]) for r in pii.personal_data(documents(spark, rows)).collect()}
    assert {(50, "phone:25:37"), (None, "phone:25:37"), (None, "")} <= got


def test_boilerplate_lines_of_rows_without_ids(spark):
    rows = [(i if i < 8 else None, f"share this line\nown {i}", "en", f"s{i}") for i in range(12)]
    got = {r["text"] for r in line_dedup.cleaned(documents(spark, rows)).collect()}
    assert got == {"share this line\nown 0", *(f"own {i}" for i in range(1, 12))}
    rows = [(None, f"share this line\nown {i}", "en", f"s{i}") for i in range(12)]
    got = [r["text"] for r in line_dedup.cleaned(documents(spark, rows)).collect()]
    assert sum(t.startswith("share") for t in got) == 1 and len(got) == 12
