"""How well predictions along the temperature follow a smooth curve: hold-out points, curve agreement, bias and a composite score per pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.operators.fits import apelblat_fits, curve_at


def holdout_points(df: DataFrame, keys: list[str], t: str, least: int = 7) -> DataFrame:
    """Rows of pairs with enough temperatures, with ``held`` true at the first, middle and last of them."""
    from pyspark.sql import Window as W

    each = W.partitionBy(*keys)
    rows = df.withColumns({"_r": F.row_number().over(each.orderBy(t)) - 1, "_n": F.count(F.lit(1)).over(each)}).where(F.col("_n") >= least)
    return rows.withColumn("held", (F.col("_r") == 0) | (F.col("_r") == F.floor(F.col("_n") / 2)) | (F.col("_r") == F.col("_n") - 1)).drop("_r", "_n")


def consistency(df: DataFrame, keys: list[str], t: str, y: str, pred: str, points: int = 50) -> DataFrame:
    """Per pair: r2 and rmse of the predictions, correlation of the curves fitted to values and predictions on a grid, ratio of their slopes, the side on which predictions lie, and a score.

    The score weighs r2 and shape by 0.3 each, the slope ratio and the balance by 0.2 each.
    """
    e = F.col(pred) - F.col(y)
    base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("_mse"), F.var_pop(y).alias("_v"), F.avg((e > 0).cast("double")).alias("above"), F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    one = apelblat_fits(df, keys, t, y).select(*keys, *(F.col(c).alias(f"m_{c}") for c in "abc"))
    two = apelblat_fits(df, keys, t, pred).select(*keys, *(F.col(c).alias(f"p_{c}") for c in "abc"))
    both = base.join(one, keys).join(two, keys)
    grid = both.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * k / (points - 1))).alias("g"), *(f"{p}_{c}" for p in "mp" for c in "abc"))
    shape = grid.groupBy(*keys).agg(F.corr(curve_at(F.col("g"), "m_"), curve_at(F.col("g"), "p_")).alias("shape"), F.regr_slope(curve_at(F.col("g"), "m_"), F.col("g")).alias("_sm"), F.regr_slope(curve_at(F.col("g"), "p_"), F.col("g")).alias("_sp"))
    out = both.join(shape, keys)
    r2 = F.when(F.col("_v") > 0, 1 - F.col("_mse") / F.when(F.col("_v") > 0, F.col("_v")))
    ratio = F.try_divide("_sp", "_sm")
    out = out.select(*keys, "n", r2.alias("r2"), F.sqrt("_mse").alias("rmse"), "shape", ratio.alias("slope_ratio"), "above", F.when(F.col("above") > 0.6, "above").when(F.col("above") < 0.4, "below").otherwise("intersects").alias("side"))
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))
    score = 0.3 * unit(F.col("r2")) + 0.3 * unit(F.col("shape")) + 0.2 * unit(1 - F.abs(1 - F.col("slope_ratio"))) + 0.2 * (1 - 2 * F.abs(F.col("above") - 0.5))
    return out.withColumn("score", score).withColumn("category", F.when(F.col("score") >= 0.8, "strong").when(F.col("score") >= 0.6, "good").when(F.col("score") >= 0.4, "weak").otherwise("poor"))


def curve_residuals(df: DataFrame, keys: list[str], t: str, y: str, pred: str) -> DataFrame:
    """Each point's error of the prediction and of the pair's own fitted curve."""
    fits = apelblat_fits(df, keys, t, y).select(*keys, "a", "b", "c")
    return df.join(fits, keys).select(*keys, t, (F.col(pred) - F.col(y)).alias("model_error"), (curve_at(F.col(t)) - F.col(y)).alias("curve_error"))


def smoothness(df: DataFrame, keys: list[str], t: str, pred: str) -> DataFrame:
    """Per pair: mean absolute second difference of predictions in order of temperature, and sign changes of the first."""
    from pyspark.sql import Window as W

    each = W.partitionBy(*keys).orderBy(t)
    rows = df.withColumns({"_d": F.col(pred) - F.lag(pred).over(each)})
    rows = rows.withColumn("_d0", F.lag("_d").over(each))
    return rows.groupBy(*keys).agg(F.avg(F.abs(F.col("_d") - F.col("_d0"))).alias("roughness"), F.count_if(F.signum("_d") * F.signum("_d0") < 0).alias("turns"))
