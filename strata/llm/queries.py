"""Queries p7 to p9 over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import packing, reading, tokens
from strata.scratch import Scratch


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(_documents(spark, sf_dir), "doc_id", "text")


def p7_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids with the characters that each covers."""
    return tokens.encode(_documents(spark, sf_dir), "doc_id", "text", offsets=True)


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that comes back from the ids; a null text comes back empty."""
    return tokens.decode(p7_ids(spark, sf_dir), "doc_id", "ids")


def p8_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document, or piece of one, lies, for each capacity."""
    scratch = Scratch(spark)
    sized = tokens.count(_documents(spark, sf_dir), "doc_id", "text").select(F.col("doc_id").alias("id"), "n_tokens")
    packed = packing.pack(sized, spark.read.parquet(f"{sf_dir}/pack_sizes.parquet"), scratch=scratch)
    return packed.withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: containers, tokens and the least number of containers that could hold them."""
    packs = spark.read.parquet(f"{sf_dir}/pack_sizes.parquet").select("pack_id", "capacity")
    got = p8_packs(spark, sf_dir).groupBy("pack_id").agg(F.countDistinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return got.join(packs, "pack_id").select(
        "pack_id", "capacity", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("at_least"),
        (F.col("containers") - F.ceil(F.col("tokens") / F.col("capacity"))).alias("above_bound"), (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused"),
    )


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words of its own prose and their estimated level."""
    return reading.levels(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/reading_labels.parquet"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_levels(spark, sf_dir).where((F.col("n_words") >= reading.LEAST_WORDS) & (F.col("level") >= 3.5)).select("doc_id")


QUERIES = {
    "p7_ids": p7_ids, "p7_offsets": p7_offsets, "p7_decoded": p7_decoded,
    "p8_packs": p8_packs, "p8_fill": p8_fill, "p9_found": p9_found, "p9_levels": p9_levels,
}

SQL = {"p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
