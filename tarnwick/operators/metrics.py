"""Error metrics of predictions, noise floors, and simple baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def metric_suite(df: DataFrame, split: str, solvent: str, y: str, pred: str, sigma: str | None = None, clip: float = 0.01) -> DataFrame:
    """Per split: n, rmse, mae, r2, ps_rmse, ps_r2, n_solvents, and z_rmse, f_aleatoric, n_uncertain where sigma is positive. One pass by split and solvent, then
    sums of those."""
    e = F.col(y) - F.col(pred)
    s = F.col(sigma) if sigma else F.lit(None).cast("double")
    s = F.when(s > 0, s)
    z = e / F.greatest(s, F.lit(clip))
    rows = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    each = rows.groupBy(split, solvent).agg(
        F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.sum(F.abs(e)).alias("sae"), F.avg(y).alias("m"), F.var_pop(y).alias("v"),
        F.sum(F.when(s.isNotNull(), z * z)).alias("zz"), F.count(s).alias("nz"), F.count_if(F.abs(e) <= 2 * s).alias("inside"),
    )
    n, many = F.sum("n"), F.col("n") >= 2
    sst = F.sum(F.col("n") * (F.col("v") + F.col("m") * F.col("m"))) - F.sum(F.col("n") * F.col("m")) * F.sum(F.col("n") * F.col("m")) / n
    return each.groupBy(split).agg(
        n.alias("n"), F.sqrt(F.sum("sse") / n).alias("rmse"), (F.sum("sae") / n).alias("mae"), F.when(n >= 2, F.when(sst > 1e-12, 1 - F.sum("sse") / F.when(sst > 1e-12, sst)).otherwise(0.0)).alias("r2"),
        F.avg(F.when(many, F.sqrt(F.col("sse") / F.col("n")))).alias("ps_rmse"), F.avg(F.when(many & (F.col("v") > 0), 1 - F.col("sse") / (F.col("n") * F.when(F.col("v") > 0, F.col("v"))))).alias("ps_r2"), F.count_if(many).alias("n_solvents"),
        F.sqrt(F.sum("zz") / F.nullif(F.sum("nz"), F.lit(0))).alias("z_rmse"), (F.sum("inside") / F.nullif(F.sum("nz"), F.lit(0))).alias("f_aleatoric"), F.sum("nz").alias("n_uncertain"),
    )


def robust_errors(df: DataFrame, split: str, y: str, pred: str, least: float = 0.01) -> DataFrame:
    """Per split: median absolute error, and the mean percentage error of values that aren't nearly zero."""
    e = F.abs(F.col(y) - F.col(pred))
    return df.groupBy(split).agg(F.median(e).alias("medae"), F.avg(F.when(F.abs(F.col(y)) > least, 100 * e / F.nullif(F.abs(F.col(y)), F.lit(0.0)))).alias("mape"))


def dummy_baseline(train: DataFrame, test: DataFrame, group: str, y: str, name: str = "pred") -> DataFrame:
    """test with the group's training mean, or the mean of all training rows for an unseen group."""
    means = train.groupBy(group).agg(F.avg(y).alias("_m"))
    overall = train.agg(F.avg(y).alias("_all"))
    return test.join(means, group, "left").crossJoin(overall).withColumn(name, F.coalesce("_m", "_all")).drop("_m", "_all")  # one row


def anova(df: DataFrame, group: str, y: str) -> DataFrame:
    """One row: share of the variance between groups, and F."""
    g = df.groupBy(group).agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v")).where("n > 0")
    mean = g.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_mean"))
    s = g.crossJoin(mean).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("_mean"), 2)).alias("ssb"), F.sum(F.col("n") * F.col("v")).alias("ssw"))  # one row
    return s.select("k", "n", F.try_divide("ssb", F.col("ssb") + F.col("ssw")).alias("share"), F.try_divide(F.col("ssb") * (F.col("n") - F.col("k")), F.col("ssw") * (F.col("k") - 1)).alias("f"))


def duplicate_floor(df: DataFrame, keys: list[str], t: str, y: str) -> DataFrame:
    """One row: spread of repeated measurements of one group at one temperature (rounded to 1 K): rms and mean absolute residual, and percentiles of the deviations."""
    g = [*keys, "_t"]
    rows = df.withColumn("_t", F.bround(t, 0))
    each = W.partitionBy(*g)
    rows = rows.withColumns({"_m": F.avg(y).over(each), "_n": F.count(y).over(each)}).where("_n >= 2")
    d = F.col(y) - F.col("_m")
    sums = rows.groupBy(*g).agg(F.sum(d * d).alias("ss"), F.sum(F.abs(d)).alias("sa"), F.count(F.lit(1)).alias("n"), F.stddev_samp(y).alias("s"))
    p = lambda q: F.percentile("s", F.lit(q))
    return sums.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_rows"), F.sqrt(F.sum("ss") / F.sum("n")).alias("rms"), (F.sum("sa") / F.sum("n")).alias("mae"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.max("s").alias("most"))


def sigma_floor(df: DataFrame, sigma: str) -> DataFrame:
    """One row: root mean square of the positive uncertainties."""
    s = F.when(F.col(sigma) > 0, F.col(sigma))
    return df.agg(F.sqrt(F.avg(s * s)).alias("sigma_rms"), F.count(s).alias("n"))


def preferred_floor(duplicates: DataFrame, sigmas: DataFrame) -> DataFrame:
    """One row: the duplicates' floor, else that of the uncertainties, and which it is."""
    both = duplicates.select("rms").crossJoin(sigmas.select("sigma_rms"))  # two single rows
    return both.select(F.coalesce("rms", "sigma_rms").alias("floor"), F.when(F.col("rms").isNotNull(), "duplicates").when(F.col("sigma_rms").isNotNull(), "sigma").otherwise("none").alias("kind"))


def pair_offsets(train: DataFrame, test: DataFrame, keys: list[str], y: str, pred: str) -> DataFrame:
    """test with the mean signed training error of its pair (0 for unseen pairs) and the corrected prediction."""
    stats = train.groupBy(*keys).agg(F.avg(F.col(y) - F.col(pred)).alias("offset"))
    return test.join(stats, keys, "left").na.fill(0.0, ["offset"]).withColumn("corrected", F.col(pred) + F.col("offset"))


def error_stats(df: DataFrame, keys: list[str], y: str, pred: str) -> DataFrame:
    e = F.col(y) - F.col(pred)
    return df.groupBy(*keys).agg(F.avg(e).alias("mean_error"), F.stddev_samp(e).alias("std_error"), F.count(e).alias("n"), F.avg(y).alias("mean_y"), F.avg(pred).alias("mean_pred"))


def biased_predictor(train: DataFrame, test: DataFrame, group: str, y: str, raw: str) -> DataFrame:
    """test with raw plus the group's mean training residual, else plus the overall one."""
    return dummy_baseline(train.withColumn("_r", F.col(y) - F.col(raw)), test, group, "_r", "_bias").withColumn("pred", F.col(raw) + F.coalesce("_bias", F.lit(0.0))).drop("_bias")


def gradients(df: DataFrame, keys: list[str], t: str, y: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """keys, t, gradient of the means at distinct temperatures: second order inside for uneven steps, one-sided at the ends; only those between the limits."""
    means = df.groupBy(*keys, t).agg(F.avg(y).alias("_y"))
    each = W.partitionBy(*keys).orderBy(t)
    rows = means.withColumns({"_y0": F.lag("_y").over(each), "_y2": F.lead("_y").over(each), "_h1": F.col(t) - F.lag(t).over(each), "_h2": F.lead(t).over(each) - F.col(t)})
    h1, h2 = F.col("_h1"), F.col("_h2")
    inner = (h1 * h1 * F.col("_y2") + (h2 * h2 - h1 * h1) * F.col("_y") - h2 * h2 * F.col("_y0")) / (h1 * h2 * (h1 + h2))
    g = F.when(h1.isNotNull() & h2.isNotNull(), inner).when(h2.isNotNull(), (F.col("_y2") - F.col("_y")) / h2).when(h1.isNotNull(), (F.col("_y") - F.col("_y0")) / h1)
    return rows.select(*keys, t, g.alias("gradient")).where((F.col("gradient") > low) & (F.col("gradient") < high))
