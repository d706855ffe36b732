"""Every query of the catalogue with SQL gives what DuckDB gives on the smallest tables."""

import duckdb
import pytest

from assure import queries as catalogue
from assure import run_queries  # noqa: F401  registers its queries

FAST = [k for k in catalogue.SQL if k.startswith(("f_", "ingest_", "rate_", "close_", "tool_", "determinism"))] + [
    "match_p0_components", "match_p1_exact", "match_p3_band", "match_residual", "units_completeness", "findings_all", "exception_queue", "metrics_all", "constraint_violations",
    "match_p0_edges", "match_p0_routing", "match_ids", "finding_ids", "finding_trace_steps", "contested_key", "constraint_catalogue", "escalation_grounds", "resolution_invariants",
    "resolution_hashes", "score_fabrication", "truth_closure", "exceptions_by_record", "report_exceptions", "variance_bars", "refund_rollup", "run_tables_counts", "batch_budget_cutoff",
    "append_only_versions", "investigation_rounds", "investigation_calls", "stored_run_metrics",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(row):
    return tuple(None if v is None else float(f"{v:.12g}") if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", FAST)
def test_query(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf)
    want = duck.sql(catalogue.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    ours = sorted((plain(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    theirs = sorted((plain(r) for r in duck.sql(f"SELECT {quoted} FROM ({catalogue.SQL[name]})").fetchall()), key=repr)
    assert ours == theirs
