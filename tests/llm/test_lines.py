"""Line dedup on very long texts and with clashing names."""

import time

from assure.llm import line_dedup


def test_many_lines_and_clashing_names(spark):
    shared = "\n".join(["the same line"] * 100_000)
    rows = [(1, shared + "\nown", "s0", 7, "x")] + [(10 + i, f"the same line\nown {i}", f"s{i}", 7, "x") for i in range(11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _lines_removed int, _gone string")
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in line_dedup.cleaned(docs).collect()}
    assert time.perf_counter() - began < 60
    assert line_dedup.cleaned(docs).columns == [*docs.columns, "__lines_removed"]
    assert got[1]["text"] == "the same line\nown" and got[1]["__lines_removed"] == 99_999 and got[1]["_lines_removed"] == 7
    assert all(got[10 + i]["text"] == f"own {i}" and got[10 + i]["_gone"] == "x" for i in range(11))
