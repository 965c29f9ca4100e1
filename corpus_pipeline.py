"""A training corpus from raw documents in five stages, each written as Parquet and read again by the next.

language ID (documents that it rejects go), n-gram Jaccard join (one document of each group of near duplicates stays), benchmark
decontamination (contaminated documents go, others stay as they are), secret scans (secrets are replaced by a mark), packing
(sequences of tokens). Each stage but the last returns the columns of documents. The last step, packing, has no SQL, so there is no SQL of the whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm import decontamination, jaccard_join, language_id, packing, queries_packing, secret_scans
from tarnwick.llm.columns import unused
from tarnwick.llm.graph import shared_folder


def _beside(docs: DataFrame, outputs: tuple[str, ...], rows) -> DataFrame:
    """The columns of docs for ``rows`` of docs, which an operator chooses; columns named like its outputs step aside for it."""
    clashing = [c for c in docs.columns if c.lower() in outputs]
    aside = dict(zip(clashing, unused([*docs.columns, *outputs], *clashing), strict=True))
    return rows(docs.withColumnsRenamed(aside)).select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the model is fitted on the documents' own labels."""
    model = language_id.fit(docs)
    return _beside(docs, ("lang_pred", "score", "rejected"), lambda rows: language_id.identify(rows, model).where("not rejected"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group, and all that have no near duplicate: five words a shingle, four fifths shared."""
    return jaccard_join.deduplicate(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the benchmark's windows cover less than a twentieth."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _beside(docs, ("n_words", "n_hit", "items", "contaminated", "clean_text"), lambda rows: decontamination.decontaminate(rows, items, clean=False).where("not contaminated"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    out = secret_scans.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return queries_packing.digest(packing.pack(docs, *queries_packing.public_vocabulary()))


STAGES = [("language_id", languages), ("jaccard_join", near_duplicates), ("decontamination", decontaminate), ("secret_scans", secrets), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from the table documents; what passes between them is in the shared folder."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
