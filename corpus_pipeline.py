"""From raw documents to packed sequences, each stage one operator over all that the stage before kept.

All stages take any table with doc_id, text and source: null and empty texts and repeated rows pass as rows of their own unless a
stage says otherwise, and an empty table gives an empty one. Other columns are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismal.llm import jaccard_join, line_dedup, packing, substring_dedup, toxicity
from prismal.llm.common import documents, materialize


#: Near copies: words in a shingle, and the least Jaccard index in percent.
SHINGLE, PERCENT = 5, 80


def _sized(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`; n_chars follows the text where there is such a column."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go. Without labelled documents none does."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too many of a source's documents go; a document left without lines stays, with an empty text."""
    return _sized(line_dedup.drop_boilerplate(docs), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles (Jaccard 0.8 at least) connect, the one with the smallest doc_id stays; null ids and texts without words stay."""
    return jaccard_join.keep_one(docs, SHINGLE, PERCENT)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in two places go from both; a document left without words stays, with an empty text."""
    return _sized(substring_dedup.remove_repeats(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences, and a digest of their ids; an empty text is a piece of the end id."""
    return packing.pack(docs, keep={"ids_crc32": F.crc32("ids")})


STAGES = [("toxicity", toxic), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("substring dedup", substrings), ("best-fit packing", packed)]

#: Scores and tokens aren't expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
