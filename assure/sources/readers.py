"""The four source files as raw rows: raw_id, source, line_no, and the verbatim payload."""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assure.functions.text import record_key
from assure.sources.shared import partitions, written

# The columns of the files, and the arrays of the processor's document in reading order.
COLUMNS = {
    "sellers": "seller_id seller_name category commission_bps effective_from effective_to version".split(),
    "intent": "order_id seller_name category gross_amount taxable_value gst_amount placed_at_ist status is_interstate expected_commission commission_rate_bps expected_tcs expected_tds rate_card_version".split(),
    "bank": "bank_ref credit debit value_date narration".split(),
}
ARRAYS = ("payments", "transfers", "refunds", "reversals", "disputes", "settlements")


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows with line_no from 1 in the given order: sums of partition sizes, no single-task window.

    The range partitioning is written down before it is counted, so both uses see the same rows.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    placed = written(placed)
    sizes = {r["_p"]: (r["n"], r["least"]) for r in placed.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("least")).collect()}  # one row a partition
    before, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, before - sizes[p][1] + 1))
        before += sizes[p][0]
    offsets = F.broadcast(spark.createDataFrame(starts, "_q int, _o long"))  # a row a partition
    return placed.join(offsets, F.col("_p") == F.col("_q")).withColumn("line_no", F.col("_i") + F.col("_o")).drop("_p", "_i", "_q", "_o")


#: Lines that share a running total.
BLOCK = 1 << 16


def _pieces(spark: SparkSession, path: str, end: str | None = None) -> DataFrame:
    """line_no, value: a file's pieces up to each `end` (a line feed, with or without a carriage return, by default).

    Spark deals byte ranges of the file to tasks; a range's first byte and the order of reading give the order.
    """
    read = spark.read.option("lineSep", end) if end else spark.read
    rows = read.text(path).select("value", F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("m"))
    return numbered(rows.where("value <> ''"), "at", "m").drop("at", "m")


def _with_total_before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows (line_no) with the sum of value over all earlier lines: totals of blocks, then a window in each block."""
    blocks = rows.withColumn("_b", F.expr(f"line_no div {BLOCK}")).withColumn("_v", value.cast("long"))
    sums = blocks.groupBy(F.col("_b").alias("_c")).agg(F.sum("_v").alias("_s"))  # a row for each 65,536 lines
    earlier = F.coalesce(F.sum("_s").over(W.orderBy("_c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("_v").over(W.partitionBy("_b").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    met = blocks.withColumn("_in", inside).join(F.broadcast(sums.select("_c", earlier.alias("_e"))), F.col("_b") == F.col("_c"))
    return met.withColumn(name, F.col("_in") + F.col("_e")).drop("_b", "_c", "_v", "_in", "_e")


def _quotes(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))


def csv_rows(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A headed CSV, every column text, in file order, read in splits; line_no counts its records.

    A line begins a record if an even number of quotes stands before it in the file, so quoted line breaks are put
    together again. Empty lines outside of quotes are no records.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS[source]])
    lines = _pieces(spark, path)
    if lines.where(_quotes(F.col("value")) % 2 == 1).isEmpty():
        records = lines
    else:
        kept = numbered(spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("m")), "at", "m").drop("at", "m")
        begun = written(_with_total_before(kept, _quotes(F.col("value")), "quotes").withColumn("begins", (F.col("quotes") % 2 == 0)))
        placed = _with_total_before(begun, F.col("begins").cast("int"), "earlier").withColumn("record", F.col("earlier") + F.col("begins").cast("int"))
        parts = F.sort_array(F.collect_list(F.struct("line_no", "value")))
        whole = placed.groupBy("record").agg(F.min("line_no").alias("at"), F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"))
        records = numbered(whole.where("value <> ''").select("at", "value"), "at")
    fields = F.from_csv("value", schema.simpleString()[len("struct<") : -1].replace(":", " "), {"escape": '"', "multiLine": "true"})
    rows = records.where("line_no > 1").select((F.col("line_no") - 1).alias("line_no"), fields.alias("f")).select("line_no", "f.*")
    return rows.select(record_key(f"raw_{source}", "line_no").alias("raw_id"), F.lit(source).alias("source"), "line_no", *COLUMNS[source])


def processor_rows(spark: SparkSession, path: str) -> DataFrame:
    """The processor's document: raw_id, line_no, kind, and each element as a VARIANT, so that bad numbers survive.

    The document is cut at closing braces and read in splits: its elements are objects without inner ones. A document in
    which a string holds a brace, or an element an object, is read as one value.
    """
    cut = written(_pieces(spark, path, "}"))
    text = F.regexp_replace("value", r"\\\\.", "")  # without escaped characters
    braces = F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))
    odd = (_quotes(text) % 2 == 1) | (braces > F.when(F.col("line_no") == 1, 2).otherwise(1)) | ((braces == 0) & F.col("value").contains('"id"'))
    if not cut.where(odd).isEmpty():
        items = _whole_document(spark, path)
    else:
        before = F.regexp_extract("value", r"(?s)^(.*)\{", 1)
        cut = cut.withColumn("opened", F.regexp_extract_all(F.when(F.col("value").contains("{"), before).otherwise(F.col("value")), F.lit(r'"(\w+)"\s*:\s*\['), F.lit(1)))
        # a row for each array of the document
        arrays = [(r["line_no"], r["opened"][-1]) for r in cut.where(F.size("opened") > 0).orderBy("line_no").select("line_no", "opened").collect()]
        kind = F.lit(None).cast("string")
        for at, name in arrays:
            kind = F.when(F.col("line_no") >= at, F.lit(name)).otherwise(kind)
        order = F.array_position(F.array(*map(F.lit, ARRAYS)), F.col("kind"))
        elements = cut.where(F.col("value").contains("{")).withColumn("kind", kind).withColumn("item", F.concat(F.regexp_extract("value", r"(?s)(\{[^{]*)$", 1), F.lit("}")))
        elements = elements.where(F.col("kind").isin(*ARRAYS) & (F.trim("item") != "{}"))
        items = elements.select(order.alias("a"), F.col("line_no").alias("pos"), "kind", "item")
    rows = numbered(items, "a", "pos").withColumn("item", F.parse_json("item"))
    return rows.select(record_key("raw_razorpay", "line_no").alias("raw_id"), F.lit("razorpay").alias("source"), "line_no", "kind", "item")


def _whole_document(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("doc"))
    parts = []
    for n, kind in enumerate(ARRAYS):
        part = spark.sql(f"SELECT e.pos AS pos, e.value AS item FROM {{doc}}, LATERAL variant_explode_outer(variant_get(doc, '$.{kind}', 'variant')) e", doc=doc)
        parts.append(part.where("item is not null").select(F.lit(n).alias("a"), "pos", F.lit(kind).alias("kind"), F.to_json("item").alias("item")))
    return reduce(DataFrame.unionByName, parts)


def provenance(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, sha256, bytes and extension of each file that isn't empty.

    A file is digested by one task, which reads it in order and holds a few MB of its lines at a time: it is never one value. A JSON
    file may be one line, so it is read up to each closing brace.
    """
    own = spark.newSession()  # files in one piece, and small batches: settings that others don't get
    for name, n in (("files.maxPartitionBytes", 1 << 40), ("files.openCostInBytes", 1 << 40), ("execution.arrow.maxBytesPerBatch", 8 << 20)):
        own.conf.set(f"spark.sql.{name}", str(n))
    files = own.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"))
    digests = [_digest(own, r["path"], r["bytes"]) for r in files.collect()]  # a row a file
    none = files.limit(0).select("path", F.lit("").alias("sha256"), "bytes")
    return reduce(DataFrame.unionByName, digests, none).withColumn("extension", F.element_at(F.split("path", r"\."), -1))


def _digest(spark: SparkSession, path: str, size: int) -> DataFrame:
    """path, sha256, bytes of a file that the session reads in one piece; the last line may have no end."""
    end = "}" if path.endswith(".json") else "\n"
    mark = b"\xef\xbb\xbf"  # of UTF-8, which the reader leaves out

    def digested(batches):
        read, plain, marked = 0, hashlib.sha256(), hashlib.sha256(mark)
        for b in batches:
            data = b"".join(b.column(0).to_pylist())
            plain.update(data)
            marked.update(data)
            read += len(data)
        own, read = (marked, read + len(mark)) if size - read >= len(mark) else (plain, read)
        if read < size:
            own.update(end.encode())
            read += len(end)
        if read != size:
            raise ValueError(f"{path}: {read} bytes read of {size}")
        yield pa.RecordBatch.from_pydict({"path": [path], "sha256": [own.hexdigest()], "bytes": [size]})

    first = F.monotonically_increasing_id() == 0
    lines = spark.read.option("lineSep", end).text(path)
    return lines.select(F.concat(F.when(first, "").otherwise(end), "value").cast("binary")).mapInArrow(digested, "path string, sha256 string, bytes long")
