"""Profiles of a measurement table: coverage, spread, consistency, outliers and suspicion flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwick.functions.scalar import is_round, significant_digits
from tarnwick.operators.keys import join_back


def with_group_stats(df: DataFrame, keys: list[str], y: str) -> DataFrame:
    """df with the group's median, n and sample deviation on each row: aggregates, joined back, so no task holds a group."""
    return join_back(df, df.groupBy(*keys).agg(F.median(y).alias("group_median"), F.count(y).alias("group_n"), F.stddev_samp(y).alias("group_std")), keys)


def at_least_sources(df: DataFrame, keys: list[str], source: str, levels: list[int]) -> DataFrame:
    """One row: groups with at least so many sources, a column ge_<n> for each level."""
    sizes = df.groupBy(*keys).agg(F.count_distinct(source).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_groups"), *(F.count_if(F.col("n") >= k).alias(f"ge_{k}") for k in levels))


def steady_groups(df: DataFrame, keys: list[str], y: str, most: float = 0.7) -> DataFrame:
    """Mean, deviation and n of groups whose sample deviation (0 for one row) is below a limit."""
    stats = df.groupBy(*keys).agg(F.avg(y).alias("mean"), F.coalesce(F.stddev_samp(y), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("n"))
    return stats.where(F.col("std") < most)


def coverage(df: DataFrame, key: str, tops: list[int]) -> DataFrame:
    """top, share: the share of all rows that the largest keys have."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    best = sizes.orderBy(F.desc("n"), key).limit(max(tops)).withColumn("r", F.row_number().over(W.orderBy(F.desc("n"), key)))
    wanted = df.sparkSession.createDataFrame([(k,) for k in tops], "top long")
    return wanted.join(best, F.col("r") <= F.col("top")).groupBy("top").agg(F.sum("n").alias("rows")).crossJoin(total).select("top", "rows", (F.col("rows") / F.col("total")).alias("share"))


def running_share(df: DataFrame, key: str) -> DataFrame:
    """key, n, rank, share of all rows up to this rank. By counting sizes first, only distinct sizes go through one window."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    levels = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    above = W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)
    levels = levels.select("n", F.coalesce(F.sum("k").over(above), F.lit(0)).alias("ranks"), F.coalesce(F.sum(F.col("k") * F.col("n")).over(above), F.lit(0)).alias("rows"), F.sum(F.col("k") * F.col("n")).over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"))
    placed = sizes.withColumn("r", F.row_number().over(W.partitionBy("n").orderBy(key))).join(levels, "n")
    return placed.select(key, "n", (F.col("ranks") + F.col("r")).alias("rank"), ((F.col("rows") + F.col("r") * F.col("n")) / F.col("total")).alias("share"))


def share_reached(shares: DataFrame, targets: list[float]) -> DataFrame:
    """target, rank: the first rank of running_share whose share reaches each target."""
    return shares.agg(*(F.min(F.when(F.col("share") >= t, F.col("rank"))).alias(f"at_{round(100 * t)}") for t in targets))


def crosstab(df: DataFrame, row: str, column: str, rows: int, columns: int) -> DataFrame:
    """Counts of the most frequent rows by the most frequent columns; 0 where there is none."""
    top = lambda c, k: df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), c).limit(k).select(c)
    names = [r[0] for r in top(column, columns).collect()]
    kept = df.join(F.broadcast(top(row, rows)), row).where(F.col(column).isin(names))
    return kept.groupBy(row).pivot(column, sorted(names)).count().na.fill(0)


def inconsistent(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """key with the number of distinct values of each identifier, where one has several; nulls don't count."""
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.count_distinct(c).alias(f"n_{c}") for c in names))
    several = F.lit(False)
    for c in names:
        several = several | (F.col(f"n_{c}") > 1)
    return out.where(several)


def merge_sizes(df: DataFrame, canonical: str, raw: str) -> DataFrame:
    """n_raw, n: how many canonical keys have so many raw forms."""
    return df.where(F.col(canonical).isNotNull()).groupBy(canonical).agg(F.count_distinct(raw).alias("n_raw")).groupBy("n_raw").agg(F.count(F.lit(1)).alias("n"))


def failure_share(df: DataFrame, group: str, failed: Column, top: int = 20) -> DataFrame:
    out = df.groupBy(group).agg(F.count_if(failed).alias("failed"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.col("failed") / F.col("n")).orderBy(F.desc("share"), F.desc("failed"), group).limit(top)


def temperature_coverage(df: DataFrame, source: str, t: str) -> DataFrame:
    """Per source: range, median, distinct temperatures, and a class by the range."""
    out = df.groupBy(source).agg(F.min(t).alias("t_min"), F.max(t).alias("t_max"), F.median(t).alias("t_median"), F.count_distinct(t).alias("n_t"))
    span = F.col("t_max") - F.col("t_min")
    return out.withColumn("t_range", span).withColumn("kind", F.when(span == 0, "isothermal").when(span <= 10, "narrow").when(span <= 50, "medium").otherwise("wide"))


def value_clusters(df: DataFrame, y: str, values: list[float], near: float = 0.5) -> DataFrame:
    """value, exact, close: rows at each listed value and within a distance of it."""
    listed = df.sparkSession.createDataFrame([(float(v),) for v in values], "value double")
    both = df.select(y).join(F.broadcast(listed), F.abs(F.col(y) - F.col("value")) <= near, "right")  # the list is a parameter
    return both.groupBy("value").agg(F.count_if(F.col(y) == F.col("value")).alias("exact"), F.count(y).alias("close"))


def rare_and_common(df: DataFrame, key: str, y: str, least: int = 50) -> DataFrame:
    """kind, groups, mean and median of the groups' deviations, for groups below and from a size."""
    stats = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(y).alias("std"))
    return stats.groupBy(F.when(F.col("n") < least, "rare").otherwise("common").alias("kind")).agg(F.count(F.lit(1)).alias("groups"), F.avg("std").alias("mean_std"), F.median("std").alias("median_std"))


def strata(df: DataFrame, x: str, y: str, edges: list[float], least: int = 5) -> DataFrame:
    """bin, n, mean and median of y in [lo, hi) bins of x that have at least so many rows."""
    at = F.lit(None).cast("long")
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        at = F.when((F.col(x) >= a) & (F.col(x) < b), F.lit(k).cast("long")).otherwise(at)
    out = df.groupBy(at.alias("bin")).agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.median(y).alias("median"))
    return out.where((F.col("n") >= least) & F.col("bin").isNotNull())


def uniform_histogram(df: DataFrame, y: str, low: float, width: float) -> DataFrame:
    """bin, n for bins of one width from low."""
    return df.where(F.col(y).isNotNull()).groupBy(F.floor((F.col(y) - low) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def outliers(df: DataFrame, keys: list[str], y: str, least: int = 3, top: int = 50, ties: list[str] = ()) -> DataFrame:
    """The rows farthest from their group's median, in groups of enough rows."""
    rows = join_back(df, df.groupBy(*keys).agg(F.median(y).alias("group_median"), F.count(y).alias("group_n")).where(F.col("group_n") >= least), keys)
    return rows.withColumn("deviation", F.abs(F.col(y) - F.col("group_median"))).orderBy(F.desc("deviation"), *ties).limit(top)


def suspicion(df: DataFrame, source: str, y: str) -> DataFrame:
    """Sources with flags: few digits, hardly any spread, or nearly only round numbers."""
    v = F.col(y)
    s = df.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.avg(significant_digits(v)).alias("digits"), F.coalesce(F.stddev_samp(y), F.lit(0.0)).alias("std"), F.avg(is_round(v, 2).cast("double")).alias("round_share"))
    s = s.withColumns({"few_digits": (F.col("digits") <= 2) & (F.col("n") >= 10), "flat": ((F.col("std") < 0.1) & (F.col("n") >= 20)) | ((F.col("std") < 0.3) & (F.col("n") >= 50)), "round": F.col("round_share") > 0.9})
    return s.where("few_digits or flat or round")


def residuals(df: DataFrame, reported: str, computed: Column, top: int = 20, ties: list[str] = ()) -> DataFrame:
    """The rows whose reported value is farthest from the recomputed one."""
    rows = df.withColumn("residual", F.col(reported) - computed).where("residual is not null")
    return rows.orderBy(F.desc(F.abs("residual")), *ties).limit(top)


def feature_thresholds(long: DataFrame, feature: str, value: str) -> DataFrame:
    """Per feature: mean, population deviation, both two-sigma limits, min and max."""
    s = long.groupBy(feature).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return s.withColumns({"low": F.col("mean") - 2 * F.col("std"), "high": F.col("mean") + 2 * F.col("std")})


def unusual(long: DataFrame, thresholds: DataFrame, feature: str, value: str) -> DataFrame:
    """Rows outside their feature's limits, with the z value."""
    rows = long.join(thresholds.select(feature, "mean", "std", "low", "high"), feature).where((F.col(value) < F.col("low")) | (F.col(value) > F.col("high")))
    return rows.withColumn("z", F.try_divide(F.col(value) - F.col("mean"), F.col("std")))


def threshold_choices(df: DataFrame, x: str, shares: list[float], target: int) -> DataFrame:
    """strategy, threshold, n: limits at percentiles, and the one that ``target`` rows reach."""
    cuts = df.agg(*(F.percentile(x, F.lit(s)).alias(f"p{round(100 * s)}") for s in shares))
    kth = df.where(F.col(x).isNotNull()).orderBy(F.desc(x)).limit(target).agg(F.min(x).alias("target"))
    names = [f"p{round(100 * s)}" for s in shares] + ["target"]
    limits = cuts.crossJoin(kth)  # two single rows
    counts = df.select(x).crossJoin(F.broadcast(limits)).agg(*(F.count_if(F.col(x) >= F.col(n)).alias(f"n_{n}") for n in names))  # one row beside each, counted in one pass
    both = limits.crossJoin(counts)
    return both.select(F.explode(F.array(*(F.struct(F.lit(n).alias("strategy"), F.col(n).alias("threshold"), F.col(f"n_{n}").alias("n")) for n in names))).alias("s")).select("s.*").where("n > 0")


#: Ranges of a value that are put in order apart from each other.
RANGES = 256


def counts_below(sizes: DataFrame, x: str, k: str, name: str, keys: list[str] = ()) -> DataFrame:
    """sizes (keys, a distinct x, its count k) with the sum of k of all smaller x of the same keys.

    The values are cut into RANGES ranges at approximate quantiles. Each range is put in order by itself, and the ranges' sums are a bounded table, so no task orders all values.
    """
    cuts = sizes.approxQuantile(x, [i / RANGES for i in range(1, RANGES)], 1 / (4 * RANGES))
    at = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= F.col(x))) if cuts else F.lit(0)
    placed = sizes.withColumn("_range", at)
    sums = placed.groupBy(*keys, "_range").agg(F.sum(k).alias("_sum"))
    group = W.partitionBy(*keys) if keys else W.partitionBy()  # at most RANGES rows each
    before = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(k).over(W.partitionBy(*keys, "_range").orderBy(x).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return join_back(placed.withColumn("_inside", inside), before, [*keys, "_range"]).withColumn(name, F.col("_inside") + F.col("_before")).drop("_range", "_inside", "_before")


def average_ranks(df: DataFrame, x: str, name: str, keys: list[str] = ()) -> DataFrame:
    """df with the average rank of x within keys. Ranks come from the counts of distinct values."""
    sizes = df.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_k"))
    ranks = counts_below(sizes, x, "_k", "_below", list(keys)).select(*keys, x, (F.col("_below") + (F.col("_k") + 1) / 2).alias(name))
    return df.join(ranks, [*keys, x])


def spearman(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    ranked = average_ranks(average_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "_rx", keys), y, "_ry", keys)
    return ranked.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("spearman"), F.corr(x, y).alias("pearson"), F.count(F.lit(1)).alias("n"))


def mann_whitney(df: DataFrame, group: str, first: str, y: str) -> DataFrame:
    """One row: U of the first group against all others, from average ranks."""
    ranked = average_ranks(df.where(F.col(y).isNotNull()).withColumn("_first", F.col(group) == first), y, "_r")
    s = ranked.agg(F.sum(F.when(F.col("_first"), F.col("_r"))).alias("r"), F.count_if("_first").alias("n1"), F.count_if(~F.col("_first")).alias("n2"))
    return s.select("n1", "n2", (F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"))
