"""Queries of curve consistency, feature functions and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarnwick.functions import features
from tarnwick.operators import curves
from tarnwick.plans.queries_audit import fit_sql
from tarnwick.plans.views import KEYS, measurements, rounded, rounded_sql
from tarnwick.sources.tables import table
from tarnwick.streaming import rollup as streams

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


PRED = "pp AS (SELECT solute, solvent, t, avg(y) AS y, avg(y + 2e-1 * (x - 25e-2)) AS pred FROM m GROUP BY ALL)"


def _pred(spark, sf):
    return measurements(spark, sf).groupBy(*KEYS, "t").agg(F.avg("y").alias("y"), F.avg(F.col("y") + 0.2 * (F.col("x") - 0.25)).alias("pred"))


@query(rounded_sql(PRED, "SELECT solute, solvent, t, y FROM (SELECT *, row_number() OVER (PARTITION BY solute, solvent ORDER BY t) - 1 AS r, count(*) OVER (PARTITION BY solute, solvent) AS n FROM pp) WHERE n >= 7 AND (r = 0 OR r = floor(n / 2) OR r = n - 1)", "t y"))
def curve_holdout(spark, sf):
    return rounded(curves.holdout_points(_pred(spark, sf), KEYS, "t").where("held").select(*KEYS, "t", "y"))


@query(rounded_sql(PRED + ", " + fit_sql("fm", "pp", "solute, solvent") + ", " + fit_sql("fp", "pp", "solute, solvent", "pred") + """, bs AS (SELECT solute, solvent, count(*) AS n, avg((pred - y) * (pred - y)) AS mse, var_pop(y) AS v, avg(CASE WHEN pred > y THEN 1e0 ELSE 0e0 END) AS above, min(t) AS lo, max(t) AS hi FROM pp GROUP BY ALL),
  gr AS (SELECT solute, solvent, lo + (hi - lo) * k / 49 AS g FROM bs, range(50) r(k)),
  cu AS (SELECT gr.solute, gr.solvent, g, fm.a + fm.b / g + fm.c * ln(g) AS a, fp.a + fp.b / g + fp.c * ln(g) AS b FROM gr JOIN fm USING (solute, solvent) JOIN fp USING (solute, solvent)),
  sh AS (SELECT solute, solvent, corr(a, b) AS shape, regr_slope(b, g) / nullif(regr_slope(a, g), 0) AS slope_ratio FROM cu GROUP BY ALL),
  al AS (SELECT bs.solute, bs.solvent, n, 1 - mse / v AS r2, sqrt(mse) AS rmse, shape, slope_ratio, above FROM bs JOIN sh USING (solute, solvent))""",
    """SELECT *, CASE WHEN above > 6e-1 THEN 'above' WHEN above < 4e-1 THEN 'below' ELSE 'intersects' END AS side,
  3e-1 * greatest(0e0, least(1e0, coalesce(r2, 0e0))) + 3e-1 * greatest(0e0, least(1e0, coalesce(shape, 0e0))) + 2e-1 * greatest(0e0, least(1e0, coalesce(1 - abs(1 - slope_ratio), 0e0))) + 2e-1 * (1 - 2 * abs(above - 5e-1)) AS score FROM al""", "r2 rmse shape slope_ratio above score", 3))
def curve_consistency(spark, sf):
    return rounded(curves.consistency(_pred(spark, sf), KEYS, "t", "y", "pred").drop("category"), 3)


@query(rounded_sql(PRED + ", " + fit_sql("fm", "pp", "solute, solvent"), "SELECT solute, solvent, pp.t, pred - y AS model_error, a + b / pp.t + c * ln(pp.t) - y AS curve_error FROM pp JOIN fm USING (solute, solvent)", "t model_error curve_error", 3))
def curve_residuals(spark, sf):
    return rounded(curves.curve_residuals(_pred(spark, sf), KEYS, "t", "y", "pred"), 3)


@query(rounded_sql(PRED + ", d1 AS (SELECT *, pred - lag(pred) OVER k AS d FROM pp WINDOW k AS (PARTITION BY solute, solvent ORDER BY t)), d2 AS (SELECT *, lag(d) OVER k AS d0 FROM d1 WINDOW k AS (PARTITION BY solute, solvent ORDER BY t))", "SELECT solute, solvent, avg(abs(d - d0)) AS roughness, count(*) FILTER (sign(d) * sign(d0) < 0) AS turns FROM d2 GROUP BY ALL", "roughness"))
def curve_smoothness(spark, sf):
    return rounded(curves.smoothness(_pred(spark, sf), KEYS, "t", "pred"))


@query("SELECT p_partkey, length(p_type)::DOUBLE AS length, length(regexp_replace(p_type, '[^A-Z]', '', 'g'))::DOUBLE AS capitals FROM part")
def featurizer_udf(spark, sf):
    out = features.featurize(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", "letters", "f")
    return out.select("p_partkey", F.col("f")[0].alias("length"), F.col("f")[1].alias("capitals"))


@query("WITH s AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s FROM part) SELECT p_partkey, round((p_retailprice - m) / (s + 1e-8), 6) + 0e0 AS p_retailprice, p_size + p_partkey::DOUBLE AS total FROM part, s")
def group_scaler(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    out = features.GroupScaler(["p_retailprice"], {"total": ["p_size", "p_partkey", "absent"]}).fit(rows).transform(rows)
    return rounded(out.select("p_partkey", "p_retailprice", "total"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS n FROM events GROUP BY 1")
def streaming_rollup(spark, sf):
    path = f"{sf}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/events.parq*")
    return rounded(streams.collect_stream(streams.running_rollup(stream, ["event_type"], "value"), f"rollup_{uuid.uuid4().hex}"))
