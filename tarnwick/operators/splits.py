"""Reproducible splits and samples. All order is that of md5 of a seed and a row's key, so it is the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwick.operators.keys import join_back


def hash_order(seed: int | str, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def hash_rank(df: DataFrame, order: Column, name: str = "rank", ties: list[str] = (), within: list[str] = (), size: str | None = None) -> DataFrame:
    """df with the rank (from 1) by a hexadecimal hash, in each group of ``within``, and under ``size`` the group's number of rows.

    No task sorts more than one of a group's 4096 prefixes, and their counts are what the windows over a group see.
    """
    marked = df.withColumns({"_h": order, "_p": F.substring(order, 1, 3)})
    counts = marked.groupBy(*within, "_p").agg(F.count(F.lit(1)).alias("_n"))
    group = W.partitionBy(*within) if within else W.partitionBy()
    before = counts.select(*within, "_p", F.coalesce(F.sum("_n").over(group.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), *([F.sum("_n").over(group).alias(size)] if size else []))
    ranked = marked.withColumn("_r", F.row_number().over(W.partitionBy(*within, "_p").orderBy("_h", *ties)))
    joined = join_back(ranked, before, [*within, "_p"]) if within else ranked.join(F.broadcast(before), "_p")
    return joined.withColumn(name, F.col("_r") + F.col("_before")).drop("_h", "_p", "_r", "_before")


def stratified_validation(df: DataFrame, stratum: str, keys: list[str], fraction: float = 0.15, seed: int = 42) -> DataFrame:
    """df with split: validation for min(max(1, floor(n * fraction)), n - 1) rows of each stratum, none of a single row's."""
    rows = hash_rank(df, hash_order(seed, *keys), "_rank", keys, [stratum], "_size")
    n = F.col("_size")
    most = F.when(n <= 1, 0).otherwise(F.least(F.greatest(F.lit(1), F.floor(n * F.lit(fraction))), n - 1))
    return rows.withColumn("split", F.when(F.col("_rank") <= most, "validation").otherwise("train")).drop("_rank", "_size")


def group_holdout(df: DataFrame, solvent: str, solute: str, top: int = 25, fraction: float = 0.10, seed: int = 42) -> DataFrame:
    """df with split: ood outside the ``top`` solvents by rows; in those, eval for all rows of max(1, floor(n * fraction)) solutes, else train."""
    best = df.groupBy(solvent).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), solvent).limit(top).select(solvent)
    pairs = df.select(solvent, solute).distinct().join(F.broadcast(best), solvent)  # at most ``top`` rows
    each = W.partitionBy(solvent)
    ranked = pairs.withColumns({"_r": F.row_number().over(each.orderBy(hash_order(seed, solvent, solute), solute)), "_n": F.count(F.lit(1)).over(each)})
    held = ranked.select(solvent, solute, F.when(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(fraction))), "eval").otherwise("train").alias("split"))
    return df.join(held, [solvent, solute], "left").withColumn("split", F.coalesce("split", F.lit("ood")))


def holdout(df: DataFrame, keys: list[str], fraction: float, seed: int = 42) -> DataFrame:
    """df with split: test for ceil(n * fraction) rows."""
    n = df.count()
    return hash_rank(df, hash_order(seed, *keys), ties=keys).withColumn("split", F.when(F.col("rank") <= -int(-n * fraction // 1), "test").otherwise("train")).drop("rank")


def subsample(df: DataFrame, keys: list[str], fraction: float, least: int = 32, seed: int = 42) -> DataFrame:
    """max(least, round(n * fraction)) rows."""
    n = df.count()
    return hash_rank(df, hash_order(seed, *keys), ties=keys).where(F.col("rank") <= max(least, round(n * fraction))).drop("rank")


def stratified_subsample(df: DataFrame, stratum: str, keys: list[str], fraction: float, seed: int = 42) -> DataFrame:
    """max(1, round half even(n * fraction)) rows of each stratum."""
    rows = hash_rank(df, hash_order(seed, *keys), "_rank", keys, [stratum], "_size")
    return rows.where(F.col("_rank") <= F.greatest(F.lit(1), F.rint(F.col("_size") * F.lit(fraction)))).drop("_rank", "_size")


def binned_subsample(df: DataFrame, y: str, keys: list[str], size: int, bins: int = 50, seed: int = 42) -> DataFrame:
    """``size`` rows spread over equal-width bins of y: size // bins of each bin, topped up from the others."""
    lo, hi = df.agg(F.min(y), F.max(y)).head()
    width = (hi - lo) / bins if hi is not None and hi > lo else 1.0
    order = hash_order(seed, *keys)
    rows = df.withColumn("_bin", F.least(F.floor((F.col(y) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)))
    rows = hash_rank(rows, order, "_rank", keys, ["_bin"])
    first = (F.col("_rank") <= size // bins).cast("int")
    return hash_rank(rows, F.concat(F.hex(1 - first).substr(-1, 1), order), ties=keys).where(F.col("rank") <= size).drop("_bin", "_rank", "rank")


def kfold(df: DataFrame, keys: list[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """df with fold 0 .. folds - 1, of sizes that differ by one at most."""
    return hash_rank(df, hash_order(seed, *keys), ties=keys).withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(folds)).cast("long")).drop("rank")


def first_distinct(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """The first row of each key, in order, until there are ``size``."""
    first = df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    return first.orderBy(*order).limit(size)


def priority_split(df: DataFrame, keys: list[str], held: dict[str, DataFrame], default: str = "train") -> DataFrame:
    """df with the first split, in the order given, whose table has the row's keys."""
    names = list(held)
    table = None
    for k, name in enumerate(names):
        part = held[name].select(*keys, F.lit(k).alias("_p"))
        table = part if table is None else table.unionByName(part)
    best = table.groupBy(*keys).agg(F.min("_p").alias("_p"))
    label = F.element_at(F.array(*map(F.lit, names)), F.col("_p") + 1)
    return df.join(best, keys, "left").withColumn("split", F.when(F.col("_p").isNotNull(), label).otherwise(default)).drop("_p")


def leak_matrix(df: DataFrame, split: str, keys: list[str]) -> DataFrame:
    """left, right, n: distinct keys that two splits share, for each two splits that share any."""
    pairs = df.select(split, *keys).distinct()
    a, b = pairs.withColumnRenamed(split, "left"), pairs.withColumnRenamed(split, "right")
    return a.join(b, keys).where(F.col("left") < F.col("right")).groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))


def leak_report(big: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, pairs, and how many of both are in the held-out table."""
    known = held.select(*keys).distinct().withColumn("_hit", F.lit(1))
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(known, keys, "left")
    return counts.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_pairs"), F.coalesce(F.sum(F.when(F.col("_hit") == 1, F.col("n"))), F.lit(0)).alias("hit_rows"), F.count("_hit").alias("hit_pairs"))


def contained(small: DataFrame, large: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct keys of small, how many are missing from large, and whether none is."""
    left = small.select(*keys).distinct()
    missing = left.join(large.select(*keys).distinct(), keys, "left_anti").agg(F.count(F.lit(1)).alias("n_missing"))
    return left.agg(F.count(F.lit(1)).alias("n_keys")).crossJoin(missing).withColumn("is_subset", F.col("n_missing") == 0)  # two single rows


def without(df: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't in the held-out table; rows with a null key stay."""
    return df.join(held.select(*keys).distinct(), keys, "left_anti")
