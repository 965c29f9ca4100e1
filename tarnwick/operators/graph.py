"""Connected components of groups of names, as DataFrame operations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _folder(df: DataFrame) -> str:
    """The shared folder of spark.checkpoint.dir, which survives lost executors; a temporary folder only where none is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint"))
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """df in the shared folder."""
    _folder(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df in the shared folder as Parquet, where a checkpoint would be several times as large."""
    path = f"{_folder(df)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node that is reachable). Each round takes the least label of the neighbours and then that label's own label, so
    rounds follow the logarithm of the longest path in practice."""
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = materialise(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct())
    labels = materialise(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), F.col("label").alias("other")), "y").groupBy("x").agg(F.min("other").alias("least"))
        new = labels.join(near, "x").select("x", "label", F.least("label", "least").alias("new"))
        jump = labels.select(F.col("x").alias("new"), F.col("label").alias("far"))
        new = materialise(new.join(jump, "new").select("x", "label", F.least("new", "far").alias("new")))
        changed = new.where("label <> new").limit(1).count()
        labels = new.select("x", F.col("new").alias("label"))
        if not changed:
            return labels.select(F.col("x").alias("node"), F.col("label").alias("component"))


def closed_walks(edges: DataFrame, graph: str, a: str, b: str) -> DataFrame:
    """graph, n_edges, n_triangles, n_squares of simple undirected graphs: motif counts from the traces of the powers of the adjacency matrix."""
    one = edges.select(graph, F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where("x <> y").distinct()
    both = one.unionByName(one.select(graph, F.col("y").alias("x"), F.col("x").alias("y")))
    step = both.select(graph, F.col("x").alias("y"), F.col("y").alias("z"))
    paths = both.join(step, [graph, "y"]).groupBy(graph, "x", "z").agg(F.count(F.lit(1)).alias("k"))  # walks of two steps, counted
    triangles = paths.join(both.withColumnRenamed("y", "z"), [graph, "x", "z"]).groupBy(graph).agg((F.sum("k") / 6).cast("long").alias("n_triangles"))
    squares = paths.where("x < z").groupBy(graph).agg((F.sum(F.col("k") * (F.col("k") - 1) / 2) / 2).cast("long").alias("n_squares"))
    counts = one.groupBy(graph).agg(F.count(F.lit(1)).alias("n_edges"))
    return counts.join(triangles, graph, "left").join(squares, graph, "left").na.fill(0, ["n_triangles", "n_squares"])
