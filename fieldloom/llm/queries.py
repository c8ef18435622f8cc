"""Queries over whole tables, one for each operator of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import content_sort, digests, fair_mix, language, line_windows, lsh_forest, packing, secrets, toxicity, url_rules

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(_table(spark, sf_dir, "pages"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_duplicates(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.train_dictionaries(docs))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_windows.dedup_lines(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train_from(docs, _table(spark, sf_dir, "labels")))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.plan_mix(_table(spark, sf_dir, "documents"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rank = digests.ranks(digests.level_counts(docs))
    items = digests.fingerprint(_table(spark, sf_dir, "benchmark"), rank, id_col="item_id")
    return digests.match(digests.fingerprint(docs, rank), items.withColumnRenamed("doc_id", "item_id"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_url_filters, op3_minhash_near_dedup, op4_exact_dedup, op5_language_id, op6_best_fit_packing, op7_line_dedup, op8_toxicity,
        op9_source_mixing, op10_document_fingerprints,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": url_rules.SQL,
    "op4_exact_dedup": content_sort.SQL,
    "op7_line_dedup": line_windows.SQL,
    "op9_source_mixing": fair_mix.SQL,
}
