"""Aggregates as the analyses define them: bias-corrected moments, exact percentiles, guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def skew_corrected(x: str) -> Column:
    """Bias-corrected skewness; null below three values or without spread."""
    n = F.count(x).cast("double")
    return F.when((n > 2) & (F.stddev_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def kurtosis_corrected(x: str) -> Column:
    """Bias-corrected excess kurtosis; null below four values or without spread."""
    n = F.count(x).cast("double")
    return F.when((n > 3) & (F.stddev_pop(x) > 0), (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(x) + 6))


def percentiles(df: DataFrame, x: str, shares: list[float], keys: list[str] = ()) -> DataFrame:
    """Exact percentiles with linear interpolation, one column p<share> each."""
    return df.groupBy(*keys).agg(*(F.percentile(x, F.lit(s)).alias(f"p{round(100 * s)}") for s in shares))


def summary(x: str, keys: str = "") -> list[Column]:
    """n, mean, median, both deviations, min, max and range of a column."""
    return [
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_samp(x).alias("std"), F.stddev_pop(x).alias("std_pop"),
        F.min(x).alias("min"), F.max(x).alias("max"), (F.max(x) - F.min(x)).alias("range"),
    ]


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))
