"""Queries of the corpus operators over whole tables, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chunk_dedup, decontaminate, html_extract, langid, license_scan, line_frequency, mixing, resample, simhash, syncmer, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op3_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("print")).alias("fingerprint"), "component_id")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmer.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op11_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.judge(_table(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_ALL = (
    op1_benchmark_decontamination,
    op2_url_filter,
    op3_simhash_near_duplicates,
    op4_mix_sources,
    op5_language_id,
    op6_license_scan,
    op7_repeated_passages,
    op8_warc_bundles,
    op9_syncmer_fingerprints,
    op10_html_main_text,
    op11_line_quality,
    op12_centroid_clusters,
    op13_importance_resample,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {
    "op8_warc_bundles": warc.SQL,
    "op4_mix_sources": mixing.SQL,
    "op6_license_scan": license_scan.SQL,
    "op11_line_quality": line_frequency.SQL,
    "op12_centroid_clusters": centroids.SQL,
    "op13_importance_resample": resample.SQL,
}
