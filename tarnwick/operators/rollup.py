"""Roll-ups of run metrics, importances and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seed_rollup(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, population deviation and n over seeds, without NaN and null."""
    v = F.when(~F.isnan(value), F.col(value))
    return long.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n"))


def wide_results(rolled: DataFrame, row: list[str], split: str, metric: str, splits: list[str], metrics: list[str]) -> DataFrame:
    """A column <split>_<metric>_mean and _std for each of a fixed list; missing ones are null."""
    pick = lambda s, m, c: F.first(F.when((F.col(split) == s) & (F.col(metric) == m), F.col(c)), ignorenulls=True).alias(f"{s}_{m}_{c}")
    return rolled.groupBy(*row).agg(*(pick(s, m, c) for s in splits for m in metrics for c in ("mean", "std")))


def ordered_by(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """df with position: the listed values first, in the list's order, then the others by name."""
    known = F.array(*map(F.lit, order))
    return df.withColumn("position", F.nullif(F.array_position(known, F.col(column)), F.lit(0))).orderBy(F.col("position").asc_nulls_last(), column)


def learning_curve(long: DataFrame, keys: list[str], fraction: str, n: str, value: str) -> DataFrame:
    return long.groupBy(*keys, fraction).agg(F.max(n).alias("n"), F.avg(value).alias("mean")).orderBy(*keys, fraction)


def degradation(rolled: DataFrame, method: str, split: str, value: str, easy: str, hard: str) -> DataFrame:
    """method, easy, hard, delta and percent between two tiers, worst first."""
    pick = lambda s: F.first(F.when(F.col(split) == s, F.col(value)), ignorenulls=True)
    wide = rolled.groupBy(method).agg(pick(easy).alias("easy"), pick(hard).alias("hard")).where("easy is not null and hard is not null")
    return wide.withColumns({"delta": F.col("hard") - F.col("easy"), "percent": F.try_divide(100.0 * (F.col("hard") - F.col("easy")), F.col("easy"))}).orderBy(F.desc("delta"), method)


def paired_variants(rolled: DataFrame, learner: str, variant: str, value: str, first: str, second: str) -> DataFrame:
    """learner, both values and the winner (the lower one)."""
    pick = lambda s: F.first(F.when(F.col(variant) == s, F.col(value)), ignorenulls=True)
    wide = rolled.groupBy(learner).agg(pick(first).alias("first"), pick(second).alias("second")).where("first is not null and second is not null")
    return wide.withColumn("winner", F.when(F.col("first") < F.col("second"), first).when(F.col("second") < F.col("first"), second).otherwise("tie"))


def ranking(rolled: DataFrame, name: str, value: str) -> DataFrame:
    """rolled with rank by value, nulls last. rolled has a row for each method."""
    return rolled.withColumn("rank", F.row_number().over(W.orderBy(F.col(value).asc_nulls_last(), name)).cast("long"))


def importance(long: DataFrame, feature: str, value: str, block: str) -> DataFrame:
    """feature, block, mean_abs, mean, rank. There is a row for each feature."""
    g = long.groupBy(feature, block).agg(F.avg(F.abs(value)).alias("mean_abs"), F.avg(value).alias("mean"))
    return g.withColumn("rank", F.row_number().over(W.orderBy(F.desc("mean_abs"), feature)).cast("long"))


def block_shares(ranked: DataFrame, block: str) -> DataFrame:
    total = ranked.agg(F.sum("mean_abs").alias("_all"))
    g = ranked.groupBy(block).agg(F.sum("mean_abs").alias("total"))
    return g.crossJoin(total).select(block, "total", F.try_divide("total", "_all").alias("share"))  # one row


def group_importance(long: DataFrame, group: str, feature: str, value: str, groups: int = 25, least: int = 5, top: int = 5) -> DataFrame:
    """The strongest features of each of the largest groups."""
    sizes = long.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).orderBy(F.desc("_n"), group).limit(groups).select(group)
    g = long.join(F.broadcast(sizes), group).groupBy(group, feature).agg(F.avg(F.abs(value)).alias("mean_abs"))  # at most ``groups`` rows
    return g.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc("mean_abs"), feature)).cast("long")).where(F.col("rank") <= top)


def cosine_similarity(vectors: DataFrame, name: str, vector: str) -> DataFrame:
    """a < b, cosine of group fingerprints; for a bounded number of groups (their pairs are the result)."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    unit = vectors.select(name, vector, norm.alias("_n")).where("_n > 0")
    a, b = unit.select(F.col(name).alias("a"), F.col(vector).alias("va"), F.col("_n").alias("na")), unit.select(F.col(name).alias("b"), F.col(vector).alias("vb"), F.col("_n").alias("nb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (dot / (F.col("na") * F.col("nb"))).alias("cosine"))


def interactions(long: DataFrame, i: str, j: str, value: str, top: int = 50) -> DataFrame:
    """The strongest unordered pairs of different features by mean absolute value."""
    g = long.where(F.col(i) != F.col(j)).groupBy(F.least(i, j).alias("i"), F.greatest(i, j).alias("j")).agg(F.avg(F.abs(value)).alias("strength"))
    return g.orderBy(F.desc("strength"), "i", "j").limit(top)


def occlusion(long: DataFrame, keys: list[str], value: str, least: int = 1) -> DataFrame:
    return long.groupBy(*keys).agg(F.avg(F.abs(value)).alias("mean_abs"), F.stddev_pop(F.abs(value)).alias("std"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def contributions(long: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """Per key and group: the sum, the group's share of all absolute sums, and whether it dominates."""
    g = long.groupBy(key, group).agg(F.sum(value).alias("total"))
    each = W.partitionBy(key)
    rank = F.row_number().over(each.orderBy(F.desc(F.abs("total")), group))
    return g.withColumns({"share": F.try_divide(F.abs("total"), F.sum(F.abs("total")).over(each)), "dominant": rank == 1})


def correlated_features(df: DataFrame, features: list[str], most: float = 0.8, least_variance: float = 0.0) -> list[str]:
    """Features to keep: enough variance, and no correlation above a limit with an earlier kept one. The matrix has a row for each feature, so the greedy step is on the driver."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    v = df.agg(*(F.var_pop(f).alias(f) for f in features)).head()
    alive = [f for f in features if v[f] is not None and v[f] > least_variance]
    if not alive:
        return []
    m = Correlation.corr(VectorAssembler(inputCols=alive, outputCol="v", handleInvalid="skip").transform(df).select("v"), "v").head()[0].toArray()
    kept: list[int] = []
    for i in range(len(alive)):
        if all(abs(m[i, j]) <= most for j in kept):
            kept.append(i)
    return [alive[i] for i in kept]


def density_curve(df: DataFrame, x: str, points: int = 200) -> DataFrame:
    """grid, density: a Gaussian kernel estimate, from counts in fine bins, so its cost doesn't follow the rows."""
    s = df.where(F.col(x).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(x).alias("s"), F.min(x).alias("lo"), F.max(x).alias("hi")).head()
    if not s["n"] or not s["s"]:
        return df.sparkSession.createDataFrame([], "grid double, density double")
    h, step = s["s"] * s["n"] ** -0.2, (s["hi"] - s["lo"]) / 2000
    bins = df.where(F.col(x).isNotNull()).groupBy(F.floor((F.col(x) - s["lo"]) / step).alias("b")).agg(F.count(F.lit(1)).alias("k"))
    grid = df.sparkSession.range(points).select((F.lit(s["lo"]) + F.col("id") * ((s["hi"] - s["lo"]) / (points - 1))).alias("grid"))
    z = (F.col("grid") - (F.lit(s["lo"]) + (F.col("b") + 0.5) * step)) / h
    return grid.crossJoin(F.broadcast(bins)).groupBy("grid").agg((F.sum(F.col("k") * F.exp(-z * z / 2)) / (s["n"] * h * 2.5066282746310002)).alias("density"))  # at most 2001 bins


def fragment_importance(atoms: DataFrame, fragments: DataFrame, keys: list[str], group: list[str], value: str, top: int | None = None) -> DataFrame:
    """Mean absolute value and n of each fragment, by group. fragments: keys and fragment; an atom in several fragments counts in each. With ``top``, the strongest of each group."""
    g = atoms.join(fragments, keys).groupBy(*group, "fragment").agg(F.avg(F.abs(value)).alias("mean_abs"), F.count(F.lit(1)).alias("n"))
    if top is None:
        return g
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.desc("mean_abs"), "fragment"))
    return g.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)


def row_rollup(long: DataFrame, keys: list[str], value: str, labels: DataFrame, on: list[str]) -> DataFrame:
    """One row per key with the sum, the largest share and n of its parts, and the labels of that key (null where there are none)."""
    total = F.sum(F.abs(value))
    g = long.groupBy(*keys).agg(total.alias("total"), F.try_divide(F.max(F.abs(value)), total).alias("largest"), F.count(F.lit(1)).alias("n"))
    return g.join(labels, on, "left")


def average_linkage(similarity: DataFrame, clusters: int) -> dict[str, int]:
    """Cluster numbers of names by average linkage of 1 - cosine, from the table (a, b, cosine) of a bounded number of groups; on the driver, as its input is the small result of cosine_similarity."""
    import numpy as np

    rows = similarity.select("a", "b", "cosine").limit(500_001).collect()
    if len(rows) > 500_000:
        raise ValueError("more than 1000 groups")
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    at = {n: i for i, n in enumerate(names)}
    d = np.full((len(names), len(names)), np.inf)
    for r in rows:
        d[at[r["a"]], at[r["b"]]] = d[at[r["b"]], at[r["a"]]] = 1 - r["cosine"]
    members = [[i] for i in range(len(names))]
    live = list(range(len(names)))
    while len(live) > max(1, clusters):
        sub = d[np.ix_(live, live)]
        i, j = sorted(live[k] for k in np.unravel_index(np.argmin(sub), sub.shape))
        a, b = len(members[i]), len(members[j])
        d[i] = (a * d[i] + b * d[j]) / (a + b)
        d[:, i] = d[i]
        d[i, i] = np.inf
        members[i] += members[j]
        live.remove(j)
    return {names[k]: c for c, i in enumerate(live) for k in members[i]}
