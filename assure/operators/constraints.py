"""Integrity constraints as queries whose result must be empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConstraintError(Exception):
    """A constraint has violations."""


def _rows(name: str, df: DataFrame, key: Column) -> DataFrame:
    return df.select(F.lit(name).alias("constraint"), key.cast("string").alias("key"))


def unique(name: str, df: DataFrame, *key: str) -> DataFrame:
    twice = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return _rows(name, twice, F.concat_ws("/", *[F.col(k).cast("string") for k in key]))


def foreign_key(name: str, child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    lost = child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")
    return _rows(name, lost, F.col(column))


def holds(name: str, df: DataFrame, condition: Column, key: str) -> DataFrame:
    return _rows(name, df.where(~F.coalesce(condition, F.lit(False))), F.col(key))


def violations(*checks: DataFrame) -> DataFrame:
    """constraint, n of each constraint that is violated."""
    return reduce(DataFrame.unionByName, checks).groupBy("constraint").agg(F.count("*").alias("n"))


def enforce(*checks: DataFrame) -> None:
    bad = violations(*checks).collect()  # a row a constraint
    if bad:
        raise ConstraintError(", ".join(f"{r['constraint']}: {r['n']}" for r in bad))


def money_columns_are_whole(schema: T.StructType) -> list[str]:
    """Names of *_paise columns that are not BIGINT."""
    return [f.name for f in schema if f.name.endswith("_paise") and not isinstance(f.dataType, T.LongType)]


def json_valid(name: str, df: DataFrame, column: str, key: str) -> DataFrame:
    """Texts that are no JSON."""
    return _rows(name, df.where(F.col(column).isNotNull() & F.try_parse_json(column).isNull()), F.col(key))


def conserved(name: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """A row for each one that went missing or came from nowhere between two tables of one column of keys."""
    both = before.groupBy("k").agg(F.count("*").alias("b")).join(after.groupBy("k").agg(F.count("*").alias("a")), "k", "full")
    return _rows(name, both.where(F.coalesce("a", F.lit(0)) != F.coalesce("b", F.lit(0))), F.col("k"))


def counted(named: dict[str, DataFrame]) -> DataFrame:
    """constraint, n of each constraint, 0 where it holds."""
    return reduce(DataFrame.unionByName, [rows.agg(F.lit(name).alias("constraint"), F.count("*").alias("n")) for name, rows in named.items()])
