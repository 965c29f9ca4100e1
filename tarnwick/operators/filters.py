"""Filters that keep what pandas-style masks keep, and the recorded waterfall of several of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    """A named condition; rows for which it is false or null leave at this stage."""

    name: str
    keep: Column


def not_listed(column: str, values: list) -> Column:
    """Not in the list; null is kept."""
    return ~F.coalesce(F.col(column).isin(values), F.lit(False))


def not_matching(column: str, pattern: str) -> Column:
    """Without a match of the pattern; null is kept."""
    return ~F.coalesce(F.col(column).rlike(pattern), F.lit(False))


def within(column: str, low: float, high: float) -> Column:
    """low <= value <= high; null and NaN are dropped."""
    return F.coalesce(F.col(column).between(low, high) & ~F.isnan(column), F.lit(False))


def present(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def fit_quality(models: list[str], least_r2: float = 0.95, most_rmse: float = 0.30, t: float = 298.15) -> Column:
    """Fits of listed models that are good enough and whose range covers t."""
    return F.col("model").isin(models) & (F.col("r2") >= least_r2) & (F.col("rmse") <= most_rmse) & (F.col("t_min") <= t) & (F.col("t_max") >= t)


def pinned_temperature(df: DataFrame, t: str, low: float, high: float, value: float) -> DataFrame:
    """Rows within a temperature window, with the temperature set to one value."""
    return df.where(within(t, low, high)).withColumn(t, F.lit(value))


def _failing(stages: list[Stage]) -> Column:
    out = F.lit(len(stages))
    for k, s in reversed(list(enumerate(stages))):
        out = F.when(~F.coalesce(s.keep, F.lit(False)), k).otherwise(out)
    return out


def waterfall(df: DataFrame, stages: list[Stage]) -> tuple[DataFrame, DataFrame]:
    """The rows that pass all stages, and stage, label, removed, remaining, with one pass over the data for all counts."""
    kept = df
    for s in stages:
        kept = kept.where(s.keep)
    counts = df.groupBy(_failing(stages).alias("stage")).agg(F.count(F.lit(1)).alias("removed"))
    labels = df.sparkSession.createDataFrame([(k, s.name) for k, s in enumerate(stages)] + [(len(stages), "kept")], "stage int, label string")
    table = labels.join(counts, "stage", "left").na.fill(0, ["removed"])  # a row for each stage, so one window is enough
    later = W.orderBy(F.desc("stage")).rowsBetween(W.unboundedPreceding, -1)
    return kept, table.withColumn("remaining", F.coalesce(F.sum("removed").over(later), F.lit(0))).where(F.col("stage") < len(stages)).withColumn("stage", F.col("stage").cast("long"))


def fragments(df: DataFrame, column: str, mark: str = r"\.", top: int = 30) -> DataFrame:
    """fragment, n: the most common parts of split texts."""
    parts = df.select(F.explode(F.split(column, mark)).alias("fragment"))
    return parts.groupBy("fragment").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "fragment").limit(top)


def bucket_counts(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """bucket, lo, hi, n, percent: counts in [lo, hi) for consecutive edges; every bucket has a row."""
    table = df.sparkSession.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))], "bucket int, lo double, hi double")
    at = F.lit(None).cast("int")
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        at = F.when((F.col(column) >= float(a)) & (F.col(column) < float(b)) & ~F.isnan(column), k).otherwise(at)
    counts = df.groupBy(at.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    out = table.join(counts.where("bucket is not null"), "bucket", "left").na.fill(0, ["n"]).crossJoin(total)  # one row of totals
    return out.select(F.col("bucket").cast("long").alias("bucket"), "lo", "hi", "n", F.try_divide(100.0 * F.col("n"), F.col("total")).alias("percent"))


def domain_counts(df: DataFrame, x: str, tiny: float = 1e-10) -> DataFrame:
    """One row of counts of a mole fraction's odd values."""
    v = F.col(x)
    return df.agg(F.count_if(v > 1).alias("above_one"), F.count_if(v == 1).alias("one"), F.count_if((v > 0.99) & (v < 1)).alias("nearly_one"), F.count_if(v == 0).alias("zero"), F.count_if(v < 0).alias("negative"), F.count_if((v > 0) & (v < tiny)).alias("tiny"))
