"""Queries of the operators that compare texts: n-gram Jaccard join, decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm import decontamination, jaccard_join


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and component of near duplicates."""
    return jaccard_join.jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.decontaminate(docs, bench, clean=False)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


QUERIES = {"op1_jaccard_join": op1_jaccard_join, "op4_decontamination": op4_decontamination}
ORACLE_SQL: dict = {}
