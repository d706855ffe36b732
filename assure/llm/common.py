"""What the operators of this subpackage share: table access, shared-folder tables, Arrow helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a side may have to be broadcast; beyond it the join is left to Spark.
SMALL_ROWS = 10_000

#: Bytes of rows that a Python worker gets at once, where an application calls small_batches().
BATCH_BYTES = 8 << 20

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than there are cores, dealt over them: for work that takes long on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only where the cluster names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds of its input; for applications, which own the session: operators don't call it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The whole row in _row, beside the columns needed: names in other columns then clash with nothing."""
    return docs.select(F.struct(*docs.columns).alias("_row"), *needed)


def remove(path: str, spark: SparkSession) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_stored() -> None:
    """Delete the tables that stored() wrote; runs by itself when the driver's Python ends."""
    while _written:
        spark, path = _written.pop()
        try:
            remove(path, spark)
        except Exception:  # noqa: BLE001  the session may be gone; the next table may be another's
            continue


atexit.register(drop_stored)


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df marked for broadcast if it has no more than `most` rows, else df as it is (Spark then shuffles both sides)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def arrow_map(df: DataFrame, of_batch: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply of_batch, which returns a dict of columns, to each Arrow batch of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = of_batch(batch)
            if target is None:
                target = pa.schema([pa.field(n, KINDS[k]) for n, k in (c.split() for c in schema.split(", "))])
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def arrow_extend(df: DataFrame, of_batch: Callable[[pa.RecordBatch], list], added: str) -> DataFrame:
    """df with the columns `added` (a schema string), for which of_batch returns a list of sequences for each batch."""
    fields = [(n, KINDS[k]) for n, k in (c.split() for c in added.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                new = [pa.array(x, k) for x, (_, k) in zip(of_batch(batch), fields)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *[n for n, _ in fields]])

    schema = T.StructType(list(df.schema.fields))
    for name, kind in (c.split() for c in added.split(", ")):
        schema = schema.add(name, kind)
    return df.mapInArrow(run, schema)


KINDS = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
    "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()),
}


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """The texts of a batch one by one, nulls as empty."""
    for x in batch.column(name):
        yield x.as_py() or ""
