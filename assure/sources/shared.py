"""Tables written to the folder that the driver and all executors share, and read back."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only on a local master that names none (tests)."""
    found = spark.sparkContext.getCheckpointDir()
    if found is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="assure-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _file(spark, path)
    return bool(fs.exists(p))


def stamp(spark: SparkSession, path: str) -> tuple:
    """Name, length and time of change of each file of a table: what must be equal for it to be the same table."""
    p, fs = _file(spark, path)
    files = fs.listStatus(p)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))


#: Bytes of source tables that a task reads, those for each shuffle partition, and shuffled bytes that are put together for a task.
READ, PART, SHUFFLED = 16 << 20, 4 << 20, 16 << 20
#: Bytes of a table that joins send whole through the driver: of its files, whose rows may take a hundred times as much, and of rows that a shuffle has counted.
SENT_FILES, SENT_ROWS = 256 << 10, 2 << 20


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions before adaptive execution puts small ones together."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or 0))


def _at_most(spark: SparkSession, name: str, most: int, given: str | None = None) -> None:
    """Lower a setting in bytes, which has the value of `given` where it isn't set; below zero it stays, as that turns it off."""
    found = spark.conf.get(name, None) or spark.conf.get(given or name)
    if not found.startswith("-"):
        spark.conf.set(name, min(most, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(found)))


def small_joins(spark: SparkSession) -> None:
    """Bound what joins send through the driver by bytes that don't grow with the tables.

    Spark takes a table's size to be that of its compressed files, in which sorted ids are next to nothing: with the usual limit, what the
    driver holds of a table would grow to a hundred times that limit.
    """
    _at_most(spark, "spark.sql.adaptive.autoBroadcastJoinThreshold", SENT_ROWS, "spark.sql.autoBroadcastJoinThreshold")
    _at_most(spark, "spark.sql.autoBroadcastJoinThreshold", SENT_FILES)


def small_tasks(spark: SparkSession, paths: list[str]) -> None:
    """Let the number of tasks follow the size of the source tables, so that what one task holds doesn't grow with them; and small_joins().

    Settings of the session are only taken further: more partitions, smaller splits. Storage that can't be sized leaves these as they are.
    """
    small_joins(spark)
    try:
        size = 0
        for path in paths:
            p, fs = _file(spark, path)
            size += fs.getContentSummary(p).getLength()
    except Py4JJavaError:
        return
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", max(partitions(spark), size // PART))
    _at_most(spark, "spark.sql.files.maxPartitionBytes", READ)
    _at_most(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", SHUFFLED)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: its readers prune columns, and lost executors lose nothing."""
    spark = df.sparkSession
    path = path or f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_written() -> None:
    """Delete the tables of written(); runs by itself when the driver's Python ends."""
    while _written:
        spark, path = _written.pop()
        try:
            p, fs = _file(spark, path)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone; the next table may be another's
            continue


atexit.register(drop_written)
