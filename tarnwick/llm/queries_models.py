"""Queries of the operators that learn from labels: language ID and toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm import language_id, toxicity


def fold(column: str, folds: int):
    """crc32 of an id as text, modulo the number of folds."""
    return F.crc32(F.col(column).cast("string")) % folds


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; fold 1 of 3 is never learnt from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    model = language_id.fit(docs.where(~out & F.col("doc_id").isNotNull()))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; fold 0 of 5 is never learnt from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model = toxicity.fit(docs, labels.where(~out))
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


QUERIES = {"op5_toxicity": op5_toxicity, "op9_language_id": op9_language_id}
ORACLE_SQL: dict = {}
