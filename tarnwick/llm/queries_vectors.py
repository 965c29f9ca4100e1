"""The query of the embedding operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwick.llm import embedding_dedup


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links, component and whether it is kept."""
    return embedding_dedup.near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


QUERIES = {"op8_embedding_dedup": op8_embedding_dedup}
ORACLE_SQL: dict = {}
