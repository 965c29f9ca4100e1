"""Connected components of an edge table, and the materialising of intermediate tables."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines share; a temporary one only where none is set, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there, so lost executors lose nothing of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def text_size(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(text)).alias("n")).head()["n"] or 0


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges and the smallest node of its component, by label propagation with pointer jumping."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while len(u):
        least = np.minimum(label[u], label[v])
        most = np.maximum(label[u], label[v])
        open_ = least < most
        if not open_.any():
            break
        np.minimum.at(label, most[open_], least[open_])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return nodes, nodes[label]


def _local(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components, by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, root = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            x, y = b.column(0).to_numpy(), b.column(1).to_numpy()
            node, root = forest(np.concatenate([node, x]), np.concatenate([root, y]))
            node, root = node[node != root], root[node != root]
            if len(node) > 2_000_000:  # a bounded table; what follows starts anew
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])
                node, root = node[:0], root[:0]
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


#: Edges that one task shrinks to a forest.
EDGES_PER_TASK = 1 << 18


def components(edges: DataFrame, stored: bool = False) -> DataFrame:
    """node, component (smallest node that is reachable) for every node of the edges (a, b), by alternating large and small stars.

    The edges are written first, unless they are ``stored`` already, and so many of them shrunk to a forest in one task that groups with many edges between few nodes nearly get
    trees, however many partitions they came in. Each round is two aggregates by node and a join with their result, written to the checkpoint folder; nothing is collected but counts.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
    edges = edges if stored else checkpoint(edges)
    few = _local(edges.coalesce(max(1, -(-edges.count() // EDGES_PER_TASK))))
    now = checkpoint(few.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = checkpoint(small)
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.count_distinct("a").alias("k")).head()
        if (row["n"], row["h"]) == state or row["n"] == row["k"] and not now.join(now.select(F.col("a").alias("b")), "b", "left_semi").head(1):
            break
        state = (row["n"], row["h"])
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
