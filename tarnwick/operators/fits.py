"""Curve fits of groups: y = A + B / T + C ln T and y = A + B / T, in closed form from centred sums.

The model is linear in its parameters, so sums of centred products give the least-squares optimum. They come from Spark's variances and covariances, which are
kept about the means and merged, so rows are summed up before the shuffle and no group is ever held. u = 1000 / T keeps the sums of one size. The covariance is kept about the means (u_mean, w_mean), which avoids cancellation when a
half width is taken from it.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwick.operators.profile import counts_below

#: Below this share of Suu * Sww the temperatures don't determine three parameters.
DEGENERATE = 1e-12


def _sums(t: str, y: str) -> dict[str, Column]:
    """Sums of centred products of the rows with a temperature and a value, from which a fit is taken."""
    known = F.col(t).isNotNull() & F.col(y).isNotNull()
    x = {"u": F.when(known, 1000.0 / F.col(t)), "w": F.when(known, F.ln(F.col(t))), "y": F.when(known, F.col(y))}
    at, n = F.when(known, F.col(t)), F.count(F.when(known, F.lit(1)))
    return {
        "n_points": n, "t_min": F.min(at), "t_max": F.max(at), "u_mean": F.avg(x["u"]), "w_mean": F.avg(x["w"]), "_my": F.avg(x["y"]),
        **{f"_{c}{c}": n * F.var_pop(x[c]) for c in "uwy"}, **{f"_{a}{b}": n * F.covar_pop(x[a], x[b]) for a, b in ("uw", "uy", "wy")},
    }


#: The names of these sums.
SUMS = ["n_points", "t_min", "t_max", "u_mean", "w_mean", "_my", "_uu", "_ww", "_yy", "_uw", "_uy", "_wy"]


def apelblat_fits(df: DataFrame, keys: list[str], t: str, y: str) -> DataFrame:
    """keys, n_points, a, b, c, r2, rmse, t_min, t_max, and s2, u_mean, w_mean, cuu, cww, cuw (null covariance for three points); groups of fewer than three different temperatures are left out."""
    rows = df.where(F.col(t).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(t).alias("_t"), F.col(y).alias("_y"))
    return solved(rows.groupBy(*keys).agg(*(c.alias(name) for name, c in _sums("_t", "_y").items())), keys)


def solved(sums: DataFrame, keys: list[str]) -> DataFrame:
    """The fits of groups with the columns of ``_sums``; further columns stay."""
    more = [c for c in sums.columns if c not in keys and c not in SUMS]
    det = F.col("_uu") * F.col("_ww") - F.col("_uw") * F.col("_uw")
    sums = sums.withColumn("_det", det).where((F.col("n_points") >= 3) & (F.col("_det") > DEGENERATE * F.col("_uu") * F.col("_ww")))
    sums = sums.withColumns({"_b": (F.col("_uy") * F.col("_ww") - F.col("_wy") * F.col("_uw")) / F.col("_det"), "c": (F.col("_wy") * F.col("_uu") - F.col("_uy") * F.col("_uw")) / F.col("_det")})
    sse = F.greatest(F.lit(0.0), F.col("_yy") - F.col("_b") * F.col("_uy") - F.col("c") * F.col("_wy"))
    sums = sums.withColumns({"a": F.col("_my") - F.col("_b") * F.col("u_mean") - F.col("c") * F.col("w_mean"), "b": 1000 * F.col("_b"), "_sse": sse})
    free = F.when(F.col("n_points") > 3, F.col("n_points") - 3)
    s2 = F.col("_sse") / free
    return sums.select(
        *keys, "n_points", "a", "b", "c", F.when(F.col("_yy") > 0, 1 - F.col("_sse") / F.when(F.col("_yy") > 0, F.col("_yy"))).otherwise(0.0).alias("r2"), F.sqrt(F.col("_sse") / F.col("n_points")).alias("rmse"), "t_min", "t_max",
        s2.alias("s2"), "u_mean", "w_mean", (s2 * F.col("_ww") / F.col("_det")).alias("cuu"), (s2 * F.col("_uu") / F.col("_det")).alias("cww"), (-s2 * F.col("_uw") / F.col("_det")).alias("cuw"), *more,
    )


def vanthoff_fits(df: DataFrame, keys: list[str], t: str, y: str) -> DataFrame:
    """keys, n_points, a, b, r2, t_min, t_max of groups with two different temperatures or more."""
    x = 1000.0 / F.col(t)
    out = df.where(F.col(t).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"), F.regr_slope(F.col(y), x).alias("_b"), F.regr_intercept(F.col(y), x).alias("a"), F.regr_r2(F.col(y), x).alias("_r2"), F.min(t).alias("t_min"), F.max(t).alias("t_max")
    )
    return out.where("t_max > t_min").select(*keys, "n_points", "a", (1000 * F.col("_b")).alias("b"), F.coalesce("_r2", F.lit(1.0)).alias("r2"), "t_min", "t_max")


def taxonomy(df: DataFrame, keys: list[str], t: str) -> DataFrame:
    """keys, n_points, model: apelblat, vanthoff, isolated, or failed where temperatures repeat."""
    n = F.count_distinct(t)
    kind = F.when(n >= 3, "apelblat").when((n == 2) & (F.count(t) == 2), "vanthoff").when(F.count(t) == 1, "isolated").otherwise("failed")
    return df.groupBy(*keys).agg(F.count(t).alias("n_points"), kind.alias("model"))


def curve_at(t: Column, prefix: str = "") -> Column:
    return F.col(f"{prefix}a") + F.col(f"{prefix}b") / t + F.col(f"{prefix}c") * F.ln(t)


def half_width_at(t: Column, prefix: str = "") -> Column:
    """Half the 95 % interval of a fit at t; null without a covariance."""
    col = lambda c: F.col(f"{prefix}{c}")
    du, dw = 1000.0 / t - col("u_mean"), F.ln(t) - col("w_mean")
    var = col("s2") / col("n_points") + du * du * col("cuu") + dw * dw * col("cww") + 2 * du * dw * col("cuw")
    return 1.96 * F.sqrt(F.greatest(F.lit(0.0), var))


def good_fits(fits: DataFrame, least_r2: float) -> DataFrame:
    """Fits with a covariance that are good enough to be compared."""
    return fits.where((F.col("r2") > least_r2) & F.col("s2").isNotNull())


def fitted_groups(good: DataFrame, keys: list[str]) -> DataFrame:
    """The groups of which two sources or more are fitted."""
    return good.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select(*keys)


def interpolated(fits: DataFrame, keys: list[str], source: str, grid, most: float, least_r2: float, copies: DataFrame | None = None, copied: DataFrame | None = None) -> DataFrame:
    """Paired predictions (source1 < source2, t, y1, y2) of good fits of a group on a grid over the range that all of them cover.

    ``grid``: from the range's low and high end to an array of temperatures. ``copies`` (keys, source1, source2): only sources that aren't a copy of every
    other fitted one take part. ``copied`` (keys, source, copied) has the number of fitted sources that each one copies instead, where pairs are too many for rows.
    """
    good = good_fits(fits, least_r2)
    if copied is not None:
        sizes = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        good = good.join(sizes, keys).join(copied, [*keys, source], "left").where(F.coalesce("copied", F.lit(0)) < F.col("_n") - 1).drop("copied", "_n")
    elif copies is not None:
        one = copies.select(*keys, F.col("source1").alias(source), F.col("source2").alias("_other"))
        both = one.unionByName(one.select(*keys, F.col("_other").alias(source), F.col(source).alias("_other"))).distinct()
        # both of a copied pair must be fitted for the pair to count
        both = both.join(good.select(*keys, source), [*keys, source], "left_semi").join(good.select(*keys, F.col(source).alias("_other")), [*keys, "_other"], "left_semi")
        copied = both.groupBy(*keys, source).agg(F.count(F.lit(1)).alias("_copied"))
        sizes = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        good = good.join(sizes, keys).join(copied, [*keys, source], "left").where(F.coalesce("_copied", F.lit(0)) < F.col("_n") - 1).drop("_copied", "_n")
    told = predicted(good, keys, source, grid, most)
    a = told.select(*keys, "t", F.col(source).alias("source1"), F.col("y").alias("y1"))
    b = told.select(*keys, "t", F.col(source).alias("source2"), F.col("y").alias("y2"))
    return a.join(b, [*keys, "t"]).where("source1 < source2")


def predicted(good: DataFrame, keys: list[str], source: str, grid, most: float) -> DataFrame:
    """keys, source, t, y, ci: of each fit on a grid over the range that all fits of its group cover, where the half width is under ``most``."""
    span = good.groupBy(*keys).agg(F.max("t_min").alias("lo"), F.min("t_max").alias("hi"), F.count(F.lit(1)).alias("n")).where("n >= 2 and lo <= hi")
    at = good.join(span.select(*keys, F.explode(grid(F.col("lo"), F.col("hi"))).alias("t")), keys)
    return at.select(*keys, source, "t", curve_at(F.col("t")).alias("y"), half_width_at(F.col("t")).alias("ci")).where(F.col("ci") < most)


def disagreement(told: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Per group: n_comparisons, mae, rmse, std, max_dev of y of the smaller source less y of the larger, over all pairs of sources at equal t, from ranks and sums.
    A row's value counts once for each source that it is above, and less once for each that it is below, so no pair is a row."""
    at = W.partitionBy(*keys, "t")
    rows = told.where("y is not null").withColumns({"_n": F.count(F.lit(1)).over(at), "_y": F.col("y") - F.avg("y").over(at)})
    rows = rows.withColumns({"_above": 2 * F.row_number().over(at.orderBy("_y")) - F.col("_n") - 1, "_before": F.col("_n") + 1 - 2 * F.row_number().over(at.orderBy(source))})
    each = rows.groupBy(*keys, "t").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_y") * F.col("_above")).alias("absolute"), F.sum(F.col("_y") * F.col("_before")).alias("total"),
        (F.count(F.lit(1)) * F.sum(F.col("_y") * F.col("_y")) - F.sum("_y") * F.sum("_y")).alias("squares"), (F.max("y") - F.min("y")).alias("most"),
    ).where("n >= 2")
    n = F.sum(F.expr("n * (n - 1) div 2"))
    mean, square = F.sum("total") / n, F.sum(F.greatest(F.lit(0.0), "squares")) / n
    return each.groupBy(*keys).agg(n.alias("n_comparisons"), (F.greatest(F.lit(0.0), F.sum("absolute")) / n).alias("mae"), F.sqrt(square).alias("rmse"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("std"), F.max("most").alias("max_dev"))


def at_temperature(fits: DataFrame, t: float = 298.15, least_r2: float = 0.95, most_rmse: float = 0.30) -> DataFrame:
    """Fits that are good enough and cover t, with the curve's value there."""
    return fits.where((F.col("r2") >= least_r2) & (F.col("rmse") <= most_rmse) & (F.col("t_min") <= t) & (F.col("t_max") >= t)).withColumn("y", curve_at(F.lit(t)))


def bounded_fits(df: DataFrame, keys: list[str], t: str, y: str, a: float = 200.0, b: float = 1e5, c: float = 50.0) -> DataFrame:
    """keys, a, b, c, rmse of the least-squares fit with |A|, |B|, |C| within bounds, exactly: the best of all choices of parameters held at a bound. One small group a call."""
    limits = np.array([a, b, c])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[t, y])
        head = {k: pdf[k].iloc[0] if len(pdf) else None for k in keys}
        if pdf[t].nunique() < 3:
            return pd.DataFrame(columns=[*keys, "a", "b", "c", "rmse"])
        x = np.stack([np.ones(len(pdf)), 1 / pdf[t], np.log(pdf[t])], 1)
        scale = np.abs(x).max(0)
        best, least = None, np.inf
        for held in itertools.product((0, -1, 1), repeat=3):
            p = np.array(held) * limits
            free = [i for i in range(3) if not held[i]]
            if free:
                z = np.linalg.lstsq(x[:, free] / scale[free], pdf[y].to_numpy() - x @ p, rcond=None)[0]
                p = p.astype(float)
                p[free] = z / scale[free]
            if (np.abs(p) <= limits * (1 + 1e-9)).all():
                sse = float(((pdf[y].to_numpy() - x @ p) ** 2).sum())
                if sse < least:
                    best, least = p, sse
        return pd.DataFrame([{**head, "a": best[0], "b": best[1], "c": best[2], "rmse": np.sqrt(least / len(pdf))}])

    kinds = dict(df.dtypes)
    return df.select(*keys, t, y).groupBy(*keys).applyInPandas(solve, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", a double, b double, c double, rmse double")


def scaling_law(curves: DataFrame, keys: list[str], n: str, y: str, floor: float | None = None) -> DataFrame:
    """keys, a, b, c of y = a n^-b + c with a, c >= 0: linear in a and c for each exponent of a grid."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x, z = pdf[n].to_numpy(float), pdf[y].to_numpy(float)
        best = (np.inf, 0.0, 0.0, float(z.mean()))
        for b in np.linspace(0.01, 3, 600):
            v = x**-b
            if floor is None:
                m = np.stack([v, np.ones_like(v)], 1)
                a, c = np.linalg.lstsq(m, z, rcond=None)[0]
                if c < 0:
                    a, c = float(v @ z / (v @ v)), 0.0
            else:
                a, c = float(v @ (z - floor) / (v @ v)), floor
            sse = float(((a * v + c - z) ** 2).sum())
            if a >= 0 and sse < best[0]:
                best = (sse, a, b, c)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "a": best[1], "b": best[2], "c": best[3]}])

    kinds = dict(curves.dtypes)
    return curves.groupBy(*keys).applyInPandas(solve, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", a double, b double, c double")


def distribution_fits(df: DataFrame, x: str, counts: str | None = None) -> DataFrame:
    """law, location, scale, ks of the log-normal, exponential and half-normal laws of the positive values, by maximum likelihood.

    The Kolmogorov distance is taken over distinct values and their counts, which is the only ordered pass. ``counts``: how often each row is there, where x is distinct.
    """
    rows = df.where(F.col(x) > 0).select(F.col(x).cast("double").alias("x"), (F.lit(1) if counts is None else F.col(counts)).cast("long").alias("k"))
    n, log = F.sum("k"), F.ln("x")
    mean = lambda c: F.sum(F.col("k") * c) / n
    spread = F.sqrt(F.greatest(F.lit(0.0), mean(log * log) - mean(log) * mean(log)))
    s = rows.agg(n.alias("n"), mean(log).alias("m"), spread.alias("s"), F.min("x").alias("lo"), mean(F.col("x")).alias("mean"), F.sqrt(mean(F.col("x") * F.col("x"))).alias("rms"))
    steps = counts_below(rows if counts else rows.groupBy("x").agg(F.sum("k").alias("k")), "x", "k", "below").withColumn("upto", F.col("below") + F.col("k"))
    both = steps.crossJoin(s)  # one row of parameters
    normal = lambda z: _normal_cdf(z)
    laws = {"lognormal": (normal((F.ln("x") - F.col("m")) / F.col("s")), F.col("m"), F.col("s")), "exponential": (1 - F.exp(-(F.col("x") - F.col("lo")) / (F.col("mean") - F.col("lo"))), F.col("lo"), F.col("mean") - F.col("lo")), "halfnormal": (2 * normal(F.col("x") / F.col("rms")) - 1, F.lit(0.0), F.col("rms"))}
    out = None
    for name, (cdf, location, scale) in laws.items():
        ks = F.max(F.greatest(F.abs(cdf - F.col("upto") / F.col("n")), F.abs(cdf - (F.col("upto") - F.col("k")) / F.col("n"))))
        one = both.agg(F.lit(name).alias("law"), F.first(location).alias("location"), F.first(scale).alias("scale"), ks.alias("ks"))
        out = one if out is None else out.unionByName(one)
    return out


def _normal_cdf(z: Column) -> Column:
    """The normal law by a rational approximation with an error below 1e-7."""
    a = F.abs(z)
    k = 1 / (1 + 0.2316419 * a)
    p = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    upper = F.exp(-a * a / 2) / 2.5066282746310002 * p
    return F.when(z >= 0, 1 - upper).otherwise(upper)
