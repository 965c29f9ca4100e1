"""Consensus labels of several independent sources, and nested quality tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.operators.blocks import SMALL
from tarnwick.operators.fits import apelblat_fits, curve_at
from tarnwick.operators.graph import materialise

# Fixed limits of the nested tiers, on a pair's mean absolute difference.
TIERS = {"gold": 0.1, "silver": 0.2, "bronze": 0.5}
LEAST_MAE = 0.02


def consensus(df: DataFrame, keys: list[str], group: str, t: str, y: str, least_r2: float = 0.80, most_rmse: float = 0.30, extrapolate: float = 0.0, center: str = "mean") -> DataFrame:
    """keys, t, value, n_sources, sigma, method, groups (the sorted groups that the value is of). ``group``: the independence group of a row.

    With two good fits or more, the groups' curves are combined at the measured temperatures that all of them cover (at all measured ones, by the fits that cover each,
    if none is shared); else the groups' medians are combined at each temperature. sigma is the population deviation, null for one group.
    """
    combine = F.avg if center == "mean" else F.median
    rows = df.select(*keys, F.col(group).alias("g"), F.col(t).alias("t"), F.col(y).alias("y")).where("t is not null and y is not null")
    good = materialise(apelblat_fits(rows, [*keys, "g"], "t", "y").where((F.col("r2") >= least_r2) & (F.col("rmse") <= most_rmse)))
    fitted = materialise(good.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.max("t_min").alias("lo"), F.min("t_max").alias("hi")).where("k >= 2"))
    fitted = F.broadcast(fitted) if fitted.count() <= SMALL else fitted  # else all rows are shuffled for it
    measured = rows.select(*keys, "t").distinct().join(fitted.select(*keys, "lo", "hi"), keys)
    inside = (F.col("t") >= F.col("lo")) & (F.col("t") <= F.col("hi"))
    shared = measured.groupBy(*keys).agg(F.count_if(inside).alias("n_in"))
    points = measured.join(shared, keys).where(inside | (F.col("n_in") == 0)).select(*keys, "t")
    curves = points.join(good, keys).where((F.col("t") >= F.col("t_min") - extrapolate) & (F.col("t") <= F.col("t_max") + extrapolate)).select(*keys, "t", "g", curve_at(F.col("t")).alias("v"), F.lit("curve").alias("method"))
    medians = rows.join(fitted.select(*keys), keys, "left_anti").groupBy(*keys, "t", "g").agg(F.median("y").alias("v")).select(*keys, "t", "g", "v", F.lit("direct").alias("method"))
    n = F.count("v")
    return curves.unionByName(medians).groupBy(*keys, "t", "method").agg(combine("v").alias("value"), n.alias("n_sources"), F.when(n > 1, F.stddev_pop("v")).alias("sigma"), F.array_sort(F.collect_set("g")).alias("groups"))


def tier_membership(pairs: DataFrame, mae: str = "mae", tiers: dict[str, float] = TIERS, least: float = LEAST_MAE) -> DataFrame:
    """A row for each tier that a pair belongs to; gold is inside silver, silver inside bronze."""
    names = F.array_compact(F.array(*(F.when(F.col(mae) <= limit, F.lit(name)) for name, limit in tiers.items())))
    return pairs.where(F.col(mae) >= least).withColumn("tier", F.explode(names))


def tier_rows(labels: DataFrame, membership: DataFrame, keys: list[str], evidence: DataFrame, source: str) -> DataFrame:
    """The labels of each tier, with the sources of the pair and its mean difference."""
    told = evidence.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(source)), "|").alias("sources"))
    return labels.join(membership.select(*keys, "tier", F.col("mae").alias("interlab_mae")), keys).join(told, keys)
