"""The queries of this folder over the standard tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom.llm import collision_ann, exact_dedup, fill_in_middle, filter_audit, license_join, minhash, mixing, packing, quality, resharding, token_counts, unigram, url_filter
from tierloom.llm.durable import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(_table(spark, sf_dir, "documents"))


def op3_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = _table(spark, sf_dir, "documents"), fresh_path(spark, "shards")
    return resharding.reshard_files(docs, path, F.struct("_metadata.file_path", "_metadata.row_index"))


def op4_unigram_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.round_trip(_table(spark, sf_dir, "documents"))


def op5_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, url_filter.stand_in_list(pages))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scan_licenses(_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_texts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        op1_minhash_near_dedup, op2_exact_dedup, op3_resharding, op4_unigram_round_trip, op5_collision_ann, op6_token_counts, op7_url_filter, op8_packing, op9_license_scan, op10_quality_classifier,
        op11_fill_in_middle, op12_filter_audit, op13_source_mixing,
    )
    return {f.__name__: f for f in listed}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.ORACLE_SQL, "op7_url_filter": url_filter.ORACLE_SQL, "op9_license_scan": license_join.ORACLE_SQL,
        "op11_fill_in_middle": fill_in_middle.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL, "op13_source_mixing": mixing.ORACLE_SQL,
    }
