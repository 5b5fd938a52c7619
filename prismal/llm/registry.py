"""The queries of this subpackage, each one operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, jaccard_join, license_scan, line_dedup, packing, piece_bpe, quality_rules, substring_dedup, toxicity, wavelet
from .common import WORD, documents


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), keep={"ids_crc32": F.crc32("ids")})


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.apply_rules(documents(spark, sf_dir).select("doc_id", "text", "lang"), _labels(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.mark_exact_copies(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    kept = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"), 1)
    digest = F.sha2(F.array_join("kept", " "), 256).alias("kept_sha256")
    return found.withColumn("kept", kept).select("doc_id", (F.size("kept") + F.col("n_removed")).alias("n_words"), "n_removed", digest)


def op6_wavelet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.digests(wavelet.write_shards(documents(spark, sf_dir)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(documents(spark, sf_dir).select("doc_id", "text"), _labels(spark, sf_dir))
    return found.select("doc_id", "held_out", "score", "predicted")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, with source as the host."""
    found = line_dedup.drop_boilerplate(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_best_fit_packing, op3_quality_rules, op4_exact_dedup, op5_substring_dedup, op6_wavelet_files, op7_toxicity, op8_line_dedup, op9_jaccard_join, op10_sentencepiece, pipeline)}
ORACLES = {"op4_exact_dedup": exact_dedup.ORACLE_SQL, "op5_substring_dedup": substring_dedup.ORACLE_SQL, "op8_line_dedup": line_dedup.ORACLE_SQL, "op9_jaccard_join": jaccard_join.ORACLE_SQL}
