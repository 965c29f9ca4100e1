"""Audits of sources: copies, independence groups, agreement between sources, and how reliable each is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwick.operators.graph import components
from tarnwick.operators.pairs import range_gate
from tarnwick.operators.profile import counts_below


def copies(maes: DataFrame, near: float = 0.01) -> DataFrame:
    """The pairs that copy each other, with kind: exact, or near for a mean difference below the limit."""
    return maes.withColumn("kind", F.when(F.col("exact"), "exact").when(F.col("mae") < near, "near")).where("kind is not null")


def equal_tuples(df: DataFrame, solute: str, solvent: str, t: str, y: str, source: str, t_digits: int = 1, y_digits: int = 4) -> DataFrame:
    """Rounded tuples that several sources report: n, n_sources and the sources."""
    out = df.groupBy(solute, solvent, F.bround(F.col(t), t_digits).alias("t"), F.bround(F.col(y), y_digits).alias("y"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(source)).alias("sources")).withColumn("n_sources", F.size("sources").cast("long")).where("n_sources >= 2")


def shared_tuples(tuples: DataFrame, top: int = 20) -> DataFrame:
    """source1, source2, n: the pairs of sources with most tuples in common."""
    one = F.explode(F.transform("sources", lambda s, i: F.struct(s.alias("source1"), F.slice("sources", i + 2, F.size("sources")).alias("rest"))))
    pairs = tuples.select(one.alias("p")).select("p.source1", F.explode("p.rest").alias("source2"))
    return pairs.groupBy("source1", "source2").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source1", "source2").limit(top)


def independence_groups(edges: DataFrame, sources: DataFrame, source: str) -> DataFrame:
    """source, group_id: the smallest source that copies link it to; a source without copies is its own group."""
    found = components(edges, "source1", "source2")
    return sources.select(source).distinct().join(found, F.col(source) == F.col("node"), "left").select(source, F.coalesce("component", source).alias("group_id"))


def source_reliability(readings: DataFrame, excluded: DataFrame, keys: list[str], source: str = "source", t: str = "t", y: str = "y") -> DataFrame:
    """Per source: deviations from the median of the other sources at equal temperatures, without copies of it.

    readings: one y per group, source and temperature. The readings of a group and temperature become one sorted array, so a source's others are that array
    without it and its copies, and no pair of readings is ever a row.
    """
    one = excluded.select(*keys, F.col("source1").alias(source), F.col("source2").alias("_copy"))
    copied = one.unionByName(one.select(*keys, F.col("_copy").alias(source), F.col(source).alias("_copy"))).groupBy(*keys, source).agg(F.collect_set("_copy").alias("_copies"))
    rows = readings.join(copied, [*keys, source], "left").select(*keys, F.col(t).alias("_t"), F.struct(F.col(y).alias("y"), F.col(source).alias("s"), F.coalesce("_copies", F.array()).alias("c")).alias("r"))
    together = rows.groupBy(*keys, "_t").agg(F.array_sort(F.collect_list("r")).alias("_all")).where(F.size("_all") > 1)
    each = together.select(*keys, "_all", F.explode("_all").alias("r"))
    others = F.transform(F.filter("_all", lambda x: (x["s"] != F.col("r.s")) & ~F.array_contains(F.col("r.c"), x["s"])), lambda x: x["y"])
    each = each.select(*keys, F.col("r.s").alias(source), F.col("r.y").alias("y"), others.alias("_others")).where(F.size("_others") > 0)
    at = lambda k: F.element_at("_others", k.cast("int"))
    n = F.size("_others")
    d = F.abs(F.col("y") - (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)
    return each.groupBy(source).agg(
        F.count_distinct(*keys).alias("n_pairs"), F.count(F.lit(1)).alias("n_comparisons"), F.avg(d).alias("mae"), F.median(d).alias("median_dev"), F.max(d).alias("max_dev"), F.stddev_pop(d).alias("std_dev")
    )


def fame(reliability: DataFrame, good: float = 0.2, bad: float = 0.6) -> DataFrame:
    """The best and the worst sources, with kind."""
    return reliability.withColumn("kind", F.when(F.col("mae") <= good, "fame").when(F.col("mae") >= bad, "shame")).where("kind is not null")


def error_summary(d: Column) -> list[Column]:
    return [F.count(d).alias("n_comparisons"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.stddev_pop(d).alias("std"), F.max(F.abs(d)).alias("max_dev")]


def direct_variability(df: DataFrame, statistics: DataFrame, keys: list[str], source: str, t: str, near: float = 0.01) -> DataFrame:
    """Per group: disagreement of independent sources at equal temperatures, for pairs that pass the range gate. statistics: pair_statistics, of which copies are left out.

    What a group needs are sums over its pairs, so the points are shuffled once, for the statistics.
    """
    fine = statistics.where(~(F.col("exact") | (F.col("mae") < near)))
    kept = range_gate(df, fine, keys, source, t)
    n, total = F.sum("n_shared"), F.sum(F.col("n_shared") * F.col("mae"))
    out = kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"), n.alias("n_comparisons"), (total / n).alias("mae"), F.sqrt(F.sum("d_squares") / n).alias("rmse"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum("d_squares") / n - (F.sum("d_sum") / n) * (F.sum("d_sum") / n))).alias("std"), F.max("d_max").alias("max_dev"),
    )
    sources = kept.select(*keys, F.explode(F.array("source1", "source2")).alias("s")).groupBy(*keys).agg(F.count_distinct("s").alias("n_sources"))
    return out.join(sources, keys)


def variability(direct: DataFrame, between: DataFrame, fitted: DataFrame, keys: list[str]) -> DataFrame:
    """The groups' disagreement with its method: of the interpolated curves for groups where two sources or more are fitted (``fitted`` has those groups), of the readings at equal
    temperatures elsewhere. A fitted group without a comparison of curves has none."""
    names = [c for c in direct.columns if c in between.columns and c not in keys]
    one = direct.join(fitted.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit("direct").alias("method"), *names)
    return one.unionByName(between.join(fitted.select(*keys).distinct(), keys, "left_semi").select(*keys, F.lit("interpolated").alias("method"), *names))


def stratified_limit(variability: DataFrame) -> DataFrame:
    """Groups' mean errors by their number of sources (5 or more, 3 to 4, 2, all)."""
    strata = F.when(F.col("n_sources") >= 5, "ge5").when(F.col("n_sources") >= 3, "s3_4").when(F.col("n_sources") == 2, "s2")
    rows = variability.select("mae", F.explode(F.array_compact(F.array(strata, F.lit("all")))).alias("stratum"))
    p = lambda s: F.percentile("mae", F.lit(s))
    return rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.avg("mae").alias("mean"), F.median("mae").alias("median"), F.stddev_pop("mae").alias("std"), p(0.25).alias("p25"), p(0.75).alias("p75"), p(0.9).alias("p90"), F.sqrt(F.avg(F.col("mae") * F.col("mae"))).alias("rmse"))


def bias(points: DataFrame, limits: list[float]) -> DataFrame:
    """One row: mean and deviation of the signed differences, and the share of small ones."""
    d = F.col("y1") - F.col("y2")
    return points.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), *(F.avg((F.abs(d) <= x).cast("double")).alias(f"within_{k}") for k, x in enumerate(limits)))


def cutoff_sensitivity(points: DataFrame, cutoffs: list[float]) -> DataFrame:
    """cutoff, n, mean, median of the absolute differences that reach each cutoff, in one pass."""
    d = F.abs(F.col("y1") - F.col("y2"))
    rows = points.select(d.alias("d"), F.explode(F.array(*map(F.lit, map(float, cutoffs)))).alias("cutoff")).where("d >= cutoff")
    return rows.groupBy("cutoff").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.median("d").alias("median"))


def counted_cutoffs(sizes: DataFrame, cutoffs: list[float]) -> DataFrame:
    """cutoff_sensitivity of differences d that are there k times (``sizes``, read several times): medians by rank from ordered ranges, so no task holds all values."""
    listed = [float(c) for c in cutoffs]
    of = [(F.col("d") >= c) for c in listed]
    sums = sizes.agg(F.sum("k").alias("_all"), *(F.sum(F.when(o, F.col("k"))).alias(f"_n{i}") for i, o in enumerate(of)), *(F.sum(F.when(o, F.col("k") * F.col("d"))).alias(f"_s{i}") for i, o in enumerate(of)))
    upto = F.col("_below") + F.col("k")
    start = lambda i: F.col("_all") - F.col(f"_n{i}")
    ends = counts_below(sizes, "d", "k", "_below").crossJoin(sums)  # one row of sums
    found = ends.agg(*(F.min(F.when(upto >= start(i) + F.floor((F.col(f"_n{i}") + j) / 2) + (1 - j), F.col("d"))).alias(f"_m{i}_{j}") for i in range(len(listed)) for j in (0, 1)))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("cutoff"), F.col(f"_n{i}").alias("n"), (F.col(f"_s{i}") / F.col(f"_n{i}")).alias("mean"), ((F.col(f"_m{i}_0") + F.col(f"_m{i}_1")) / 2).alias("median")) for i, c in enumerate(listed))))
    return sums.crossJoin(found).select(each.alias("r")).select("r.*").where("n > 0")


def composite_limit(direct: DataFrame, y: str, between: DataFrame, z: str) -> DataFrame:
    """One row: sqrt(direct^2 + 2 between^2) of the two medians."""
    a, b = direct.agg(F.median(y).alias("direct")), between.agg(F.median(z).alias("between"))
    return a.crossJoin(b).withColumn("composite", F.sqrt(F.col("direct") * F.col("direct") + 2 * F.col("between") * F.col("between")))  # two single rows


def bootstrap(df: DataFrame, keys: list[str], y: str, resamples: int, seed: int = 42, statistic: Callable[[str], Column] = F.avg) -> DataFrame:
    """One row: n, value, and the 2.5 and 97.5 percentiles of the statistic (an aggregate of a column, such as F.avg or F.median) over resamples, drawn by md5
    of resample and position. For group statistics of bounded number: n * resamples rows are drawn."""
    rows = df.select(*keys, F.col(y).alias("y")).where("y is not null")
    placed = rows.withColumn("i", F.row_number().over(W.orderBy(*keys)) - 1)  # n is the number of groups
    n = placed.agg(F.count(F.lit(1)).alias("n"), statistic("y").alias("value"))
    draws = df.sparkSession.range(resamples).select(F.col("id").alias("b")).crossJoin(n).select("b", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    pick = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), F.col("j").cast("string"))), 1, 8), 16, 10).cast("long"), F.col("n"))
    drawn = draws.select("b", pick.alias("i")).join(placed.select("i", "y"), "i").groupBy("b").agg(statistic("y").alias("m"))
    ends = drawn.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return n.crossJoin(ends)
