"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and byte-level BPE, one after the other.

Each stage takes all that the one before it kept and returns the columns of documents; the last returns
doc_id, lang, source, n_tokens and ids (little-endian unsigned 32-bit integers) of each document of the mix.
Nulls, empty and repeated rows are treated as in the operators: null and empty texts fail the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assure.llm import bpe, line_dedup, mixing, quality, simhash
from assure.llm.common import small_batches, spread, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their language's perplexity bands reject go."""
    small_batches(spark)
    return quality.passing(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites stay only where they first appear; n_chars follows the text."""
    rows = line_dedup.cleaned(docs)
    return rows.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (fingerprints of 5-word shingles, 62 of 64 bits alike) the document with the smallest doc_id stays."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixing.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document of the mix."""
    small_batches(spark)
    rows = bpe.encoded(docs, carry=("doc_id", "lang", "source"))
    return rows.select("doc_id", "lang", "source", F.length("_ids").cast("long").alias("n_tokens"), bpe.id_bytes(F.col("_ids")).alias("ids"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("byte_bpe", byte_bpe),
]
#: Perplexity, fingerprints and BPE are beyond SQL; tests hold each stage's operator against a brute-force version of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's rows written and read again."""
    docs = spread(table(spark, sf_dir, "documents"))
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
