"""The registered query of each operator, with production parameters over its whole table, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, grammar, html_extract, line_dedup, mixing, negatives, pii, quality, simhash, tokens, topk, url_filter
from .common import small_batches, spread, table


def op1_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(spread(table(spark, sf_dir, "documents")))


def op2_html_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(spread(table(spark, sf_dir, "pages")))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(spread(table(spark, sf_dir, "documents")))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(spread(table(spark, sf_dir, "documents")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.byte_bpe(spread(table(spark, sf_dir, "documents")), table_words=1 << 20)


def op11_token_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.token_files(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = negatives.relabelled(F.col("vec_id"), F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_pii_bootstrap": op1_pii_bootstrap,
    "op2_html_min_cut": op2_html_min_cut,
    "op3_url_filters": op3_url_filters,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_line_dedup": op8_line_dedup,
    "op9_mixing_sources": op9_mixing_sources,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_token_grammar": op11_token_grammar,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_vector_codes": op13_vector_codes,
}
SQL: dict[str, str] = {
    "op3_url_filters": url_filter.sql(),
    "op4_exact_top_k": topk.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op12_hard_negatives": negatives.SQL,
    "op13_vector_codes": codes.sql(),
}
