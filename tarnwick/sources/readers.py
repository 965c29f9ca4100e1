"""Readers: CSV with a schema, several files at once, keyed Parquet, folders of JSON metrics, and cache-or-build."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.sources.schema import nan_to_null, require


def read_csv(spark: SparkSession, path: str, schema: T.StructType, required: set[str] = frozenset()) -> DataFrame:
    """A CSV file with a header; no pass over the data to infer types."""
    return nan_to_null(require(spark.read.csv(path, schema=schema, header=True), set(required)))


def read_tables(spark: SparkSession, folder: str, names: list[str], form: str = "parquet") -> dict[str, DataFrame]:
    """Several tables of one folder, read lazily."""
    options = {"header": True, "inferSchema": True} if form == "csv" else {}
    return {n: spark.read.format(form).options(**options).load(f"{folder}/{n}.{form}") for n in names}


def feature_store(spark: SparkSession, path: str, key: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table with one row for each key, only the wanted columns of it."""
    df = require(spark.read.parquet(path), {key, *(columns or [])})
    return df.select(key, *columns) if columns else df


def read_metrics(spark: SparkSession, pattern: str) -> DataFrame:
    """method, fraction, seed, split, metric, value of JSON records {method, fraction, seed, metrics: {split: {metric: value}}}; file is where each stood."""
    schema = "method string, fraction double, seed long, metrics map<string, map<string, double>>"
    rows = spark.read.schema(schema).json(pattern, multiLine=True).withColumn("file", F.input_file_name())
    rows = rows.select("file", "method", "fraction", "seed", F.explode("metrics").alias("split", "values"))
    return nan_to_null(rows.select("file", "method", "fraction", "seed", "split", F.explode("values").alias("metric", "value")))


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], form: str = "parquet") -> DataFrame:
    """The table at path; where there is none, it is built and written first."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        build().write.format(form).save(path)
    return spark.read.format(form).load(path)


#: Arrays that read_arrays gives tables of.
MOST_ARRAYS = 10_000


def read_arrays(spark: SparkSession, path: str, name: str = "name", values: str = "values") -> dict[str, DataFrame] | None:
    """Named arrays of one Parquet table (name, values): a table for each name, or None where there is no such table."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    df = require(spark.read.parquet(path), {name, values})
    names = [r[0] for r in df.select(name).distinct().limit(MOST_ARRAYS + 1).collect()]
    if len(names) > MOST_ARRAYS:
        raise ValueError(f"more than {MOST_ARRAYS} arrays in {path}: read the table itself")
    return {n: df.where(F.col(name) == n).select(values) for n in names}
