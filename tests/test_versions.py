"""Append-only tables: what is there stays, whatever is appended."""

import pytest

from assure.operators.constraints import ConstraintError
from assure.plans import versions

SCHEMA = "id long, what string, amount_paise long"


def test_rows_that_are_there_are_never_others(spark, tmp_path):
    path = f"file://{tmp_path}/finding"

    def append(*rows):
        return versions.append(spark, path, spark.createDataFrame(list(rows), SCHEMA), "id")

    assert append((1, "a", 5), (2, None, 6)) == 1
    assert append((2, None, 6), (3, "c", 7)) == 2
    for changed in ((1, "a", 50), (2, "b", 6), (1, None, 5)):
        with pytest.raises(versions.AppendOnly, match="1 rows"):
            append(changed, (9, "z", 1))
    with pytest.raises(ConstraintError, match="repeated key"):
        append((4, "d", 1), (4, "e", 1))
    with pytest.raises(ConstraintError, match="null key"):
        append((None, "d", 1))
    assert sorted(map(tuple, versions.table(spark, path).collect())) == [(1, "a", 5, 1), (2, None, 6, 1), (3, "c", 7, 2)]
    assert append() == 3
    # a version lost midway has no digest: it isn't read, and is written anew
    spark.createDataFrame([(8, "lost", 1)], SCHEMA).write.parquet(f"{path}/v4/rows")
    assert append((5, "e", 1)) == 4 and versions.table(spark, path).where("id = 8").isEmpty()
    spark.createDataFrame([(3, "c", 70)], SCHEMA).write.mode("overwrite").parquet(f"{path}/v2/rows")
    assert {r["version"]: r["intact"] for r in versions.intact(spark, path).collect()} == {1: True, 2: False, 3: True, 4: True}
