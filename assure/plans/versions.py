"""Append-only tables: versions of new rows, written once each; a row that is there is never another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assure.operators.constraints import enforce, unique
from assure.plans.ingest import fingerprint
from assure.sources.shared import exists, written


class AppendOnly(Exception):
    """A row that the table has was to be changed."""


def _versions(spark: SparkSession, path: str) -> int:
    """How many versions are committed: numbers from 1, the digest written last."""
    n = 0
    while exists(spark, f"{path}/v{n + 1}/digest/_SUCCESS"):
        n += 1
    return n


def table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed versions, with their version."""
    made = [spark.read.parquet(f"{path}/v{n}/rows").withColumn("version", F.lit(n)) for n in range(1, _versions(spark, path) + 1)]
    if not made:
        raise FileNotFoundError(path)
    return reduce(DataFrame.unionByName, made)


def append(spark: SparkSession, path: str, rows: DataFrame, *key: str) -> int:
    """Commit those of rows whose key is new as the next version; gives its number.

    A row that is there already, equal in all columns, is left out; one that is there with other values raises
    AppendOnly, and a key that is null or in rows twice ConstraintError, before anything is written. A version lost midway
    has no digest and is written anew. Rows are compared by key: one join of the new rows with the table.
    """
    own = rows.columns
    rows = written(rows)
    nulls = rows.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])).select(F.lit("null key").alias("constraint"), F.lit("").alias("key"))
    enforce(unique("repeated key", rows, *key), nulls)
    n = _versions(spark, path)
    new = rows
    if n:
        before = table(spark, path)
        if sorted(before.columns) != sorted([*own, "version"]):
            raise AppendOnly(f"{path}: other columns")
        old = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.struct(*own).alias("_old"))
        same_key = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(key)])
        met = rows.join(old, same_key, "left")
        changed = met.where(F.col("_old").isNotNull() & ~F.struct(*own).eqNullSafe(F.col("_old"))).count()
        if changed:
            raise AppendOnly(f"{path}: {changed} rows")
        new = met.where("_old is null").select(*own)
    here = f"{path}/v{n + 1}"
    new.write.mode("overwrite").parquet(f"{here}/rows")
    fingerprint(spark.read.parquet(f"{here}/rows")).write.mode("overwrite").parquet(f"{here}/digest")
    return n + 1


def intact(spark: SparkSession, path: str) -> DataFrame:
    """version, intact: whether each version's rows are still those that were committed, by their digest."""

    def of(n: int) -> DataFrame:
        both = spark.read.parquet(f"{path}/v{n}/digest").unionByName(fingerprint(spark.read.parquet(f"{path}/v{n}/rows")))
        return both.agg(F.lit(n).alias("version"), (F.count_distinct("n", "digest") == 1).alias("intact"))

    return reduce(DataFrame.unionByName, [of(n) for n in range(1, _versions(spark, path) + 1)])
