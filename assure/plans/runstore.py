"""A run's store: a Parquet folder for each table, written once, then a manifest as the commit marker; and its exports."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assure.operators.constraints import enforce, money_columns_are_whole


class ManifestMissing(Exception):
    """The run was not committed."""


class DirtyTree(Exception):
    """The run came from an unclean tree and that was not allowed."""


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def commit(spark: SparkSession, run_dir: str, tables: Mapping[str, DataFrame], manifest: Mapping[str, object], checks: tuple[DataFrame, ...] = ()) -> None:
    """Check the constraints, write each table where none is yet, and the manifest last; one that has a start gets its end."""
    for name, df in tables.items():
        if wrong := money_columns_are_whole(df.schema):
            raise TypeError(f"{name}: {', '.join(wrong)} must be BIGINT")
    if checks:
        enforce(*checks)
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{run_dir}/{name}")
    if "started_at" in manifest:
        manifest = {**manifest, "finished_at": int(time.time())}
    text = spark.createDataFrame([(json.dumps(dict(manifest), sort_keys=True),)], "value string")
    text.coalesce(1).write.mode("errorifexists").text(f"{run_dir}/manifest.json")


def opened(spark: SparkSession, run_dir: str, allow_dirty: bool = False) -> tuple[dict, str]:
    """The manifest, and a stamp: PROVISIONAL for an unclean tree that is allowed."""
    p, fs = _file(spark, f"{run_dir}/manifest.json/_SUCCESS")
    if not fs.exists(p):
        raise ManifestMissing(run_dir)
    manifest = json.loads(spark.read.text(f"{run_dir}/manifest.json").head()[0])
    for need in ("sample_label", "git_dirty"):
        if need not in manifest:
            raise ManifestMissing(f"{run_dir}: {need}")
    if manifest["git_dirty"] and not allow_dirty:
        raise DirtyTree(run_dir)
    return manifest, "PROVISIONAL" if manifest["git_dirty"] else "FINAL"


def export_jsonl(df: DataFrame, path: str) -> None:
    """A JSON object a line; money stays whole."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("errorifexists").text(path)
