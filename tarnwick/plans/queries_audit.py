"""Queries of source comparisons, audits, fits, consensus, tiers, metrics and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.operators import audit, blocks, filters, fits, metrics, pairs, rollup, spreads, tiers
from tarnwick.operators.graph import materialise
from tarnwick.plans.queries_basic import FEATURES, _features
from tarnwick.plans.views import KEYS, ORDER, RAW, RID, by_source, by_temperature, measurements, rounded, rounded_sql, small
from tarnwick.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- comparisons of sources -------------------------------------------------------------------------------------------

POINTS = """r AS (SELECT solute, solvent, source, round_even(t, 2) AS t, min_by(y, rid) AS y FROM m GROUP BY ALL),
  p AS (SELECT a.solute, a.solvent, a.t, a.source AS source1, b.source AS source2, a.y AS y1, b.y AS y2 FROM r a JOIN r b ON a.solute = b.solute AND a.solvent = b.solvent AND a.t = b.t AND a.source < b.source),
  mae AS (SELECT solute, solvent, source1, source2, count(*) AS n_shared, avg(abs(y1 - y2)) AS mae, bool_and(round_even(y1, 3) = round_even(y2, 3)) AS exact FROM p GROUP BY ALL)"""
COPIES = POINTS + ", c AS (SELECT *, CASE WHEN exact THEN 'exact' ELSE 'near' END AS kind FROM mae WHERE exact OR mae < 1e-2)"


NEAR = 0.01  # of copies' mean difference


def _readings(spark, sf):
    return pairs.readings(measurements(spark, sf), KEYS, "source", "t", "y", ORDER)


def _rows(spark, sf, **more):
    """A row for each source of a group, with its readings; pairs are taken of these."""
    return blocks.source_rows(by_source(spark, sf), KEYS, "source", "t", "y", ORDER, dealt="dealt", **more)


def _points(spark, sf):
    return pairs.paired(_readings(spark, sf), KEYS, "source", "t", "y")


def _differences(spark, sf):
    """Absolute differences of pairs of sources with their counts; written once, since ranks read them several times."""
    return materialise(pairs.differences(_readings(spark, sf), KEYS, "source", "t", "y"))


def _values(spark, sf):
    """The sources' values of each group and temperature, of which differences are taken."""
    return spreads.values(by_temperature(spark, sf), KEYS, "source", "t", "y", list(RID), dealt="dealt", text=True)


def _copies(spark, sf):
    return audit.copies(pairs.pair_maes(_points(spark, sf), KEYS))


@query(rounded_sql(POINTS, "SELECT * FROM mae", "mae"))
def pairwise_shared_mae(spark, sf):
    return rounded(blocks.pair_maes(_rows(spark, sf), KEYS, "source", lambda t: t.pair))


@query(rounded_sql("", """SELECT solute, solvent, source1, source2, t1, y1, t2, y2 FROM (SELECT a.solute, a.solvent, a.source AS source1, b.source AS source2, a.t AS t1, a.y AS y1, b.t AS t2, b.y AS y2, row_number() OVER (PARTITION BY a.rid, b.source ORDER BY b.rid) AS r
  FROM m a JOIN m b ON a.solute = b.solute AND a.solvent = b.solvent AND a.source < b.source AND abs(b.t - a.t) < 1e-1) WHERE r = 1""", "t1 y1 t2 y2"))
def tolerance_join(spark, sf):
    return blocks.near_readings(_rows(spark, sf, ranked=True), KEYS, "source", digits=6)


@query(rounded_sql("""ref AS (SELECT solute, solvent, median(t) AS t_ref FROM m GROUP BY ALL), d AS (SELECT m.*, t_ref, abs(t - t_ref) AS d FROM m JOIN ref USING (solute, solvent)),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY solute, solvent, source ORDER BY d, rid) AS r FROM d) WHERE r = 1 AND d <= 5)""",
    "SELECT solute, solvent, t_ref, count(*) AS n_sources, max(y) - min(y) AS y_range FROM k GROUP BY ALL HAVING count(*) >= 2", "t_ref y_range"))
def nearest_reference_range(spark, sf):
    return rounded(pairs.nearest_reference(measurements(spark, sf), KEYS, "source", "t", "y", ORDER))


LAST = "l AS (SELECT solute, solvent, source, t, max_by(y, rid) AS y FROM m GROUP BY ALL), q AS (SELECT a.solute, a.solvent, a.t, a.source AS source1, b.source AS source2, a.y AS y1, b.y AS y2 FROM l a JOIN l b ON a.solute = b.solute AND a.solvent = b.solvent AND a.t = b.t AND a.source < b.source)"


@query(rounded_sql(LAST, "SELECT solute, solvent, count(*) AS n, avg(y1 - y2) AS mean FROM q GROUP BY ALL", "mean"))
def exact_raw_join(spark, sf):
    points = pairs.paired(pairs.readings(measurements(spark, sf), KEYS, "source", "t", "y", ORDER, digits=None, last=True), KEYS, "source", "t", "y")
    return rounded(points.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y1") - F.col("y2")).alias("mean")))


SPANS = "sp AS (SELECT solute, solvent, source, min(t) AS lo, max(t) AS hi, count(*) AS n FROM m GROUP BY ALL)"


@query(rounded_sql(POINTS + ", " + SPANS, "SELECT mae.solute, mae.solvent, source1, source2 FROM mae JOIN sp a ON a.solute = mae.solute AND a.solvent = mae.solvent AND a.source = source1 JOIN sp b ON b.solute = mae.solute AND b.solvent = mae.solvent AND b.source = source2 WHERE a.hi - b.lo >= 45 OR b.hi - a.lo >= 45 OR a.n <= 1 OR b.n <= 1"))
def range_gate(spark, sf):
    return blocks.pair_maes(_rows(spark, sf), KEYS, "source", lambda t: t.apart(45.0)).select(*KEYS, "source1", "source2")


@query(rounded_sql("", "SELECT rid FROM m WHERE (solute, solvent) IN (SELECT (solute, solvent) FROM m GROUP BY solute, solvent HAVING count(DISTINCT source) >= 4)"))
def semi_join_sources(spark, sf):
    return pairs.several_sources(measurements(spark, sf), KEYS, "source", 4).select("rid")


@query(rounded_sql(COPIES, "SELECT solute, solvent, count(*) AS n FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.solute = p.solute AND c.solvent = p.solvent AND least(c.source1, c.source2) = least(p.source1, p.source2) AND greatest(c.source1, c.source2) = greatest(p.source1, p.source2)) GROUP BY ALL"))
def excluded_pairs(spark, sf):
    return blocks.shared_points(_rows(spark, sf), KEYS, "source", NEAR)


@query(rounded_sql(SPANS, "SELECT solute, solvent, source, unnest(CASE WHEN cast(ceil(lo / 5) * 5 AS int) <= cast(floor(hi / 5) * 5 AS int) THEN list_transform(range(cast(ceil(lo / 5) * 5 AS int), cast(floor(hi / 5) * 5 AS int) + 1, 5), lambda x: cast(x AS double)) ELSE [(lo + hi) / 2] END) AS g FROM sp", "g"))
def reference_grid(spark, sf):
    spans = measurements(spark, sf).groupBy(*KEYS, "source").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return rounded(spans.select(*KEYS, "source", F.explode(pairs.reference_grid(F.col("lo"), F.col("hi"))).alias("g")))


@query(rounded_sql("s AS (SELECT solute, solvent, source, list(DISTINCT t) AS ts, min(t) AS lo, max(t) AS hi FROM m GROUP BY ALL), g AS (SELECT *, unnest(list_transform(range(0, cast(floor((hi - lo + 20) / 5) AS int) + 1), lambda k: lo - 10 + k * 5)) AS g FROM s)",
    "SELECT solute, solvent, source, g FROM g WHERE len(list_filter(ts, lambda x: abs(x - g) <= 2)) = 0", "g"))
def synthetic_grid(spark, sf):
    s = measurements(spark, sf).groupBy(*KEYS, "source").agg(F.collect_set("t").alias("ts"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    return rounded(s.select(*KEYS, "source", F.explode(pairs.synthetic_grid(F.col("ts"), F.col("lo"), F.col("hi"))).alias("g")))


# --- audits -----------------------------------------------------------------------------------------------------------


@query(rounded_sql(COPIES.replace("3) = round_even(y2, 3)", "1) = round_even(y2, 1)"), "SELECT solute, solvent, source1, source2, n_shared FROM c WHERE kind = 'exact'"))
def copycat_exact(spark, sf):
    return blocks.pair_maes(_rows(spark, sf), KEYS, "source", lambda t: t.exact, digits=1).select(*KEYS, "source1", "source2", "n_shared")


@query(rounded_sql(COPIES, "SELECT solute, solvent, source1, source2, n_shared, mae FROM c WHERE kind = 'near'", "mae"))
def copycat_near(spark, sf):
    return rounded(blocks.pair_maes(_rows(spark, sf), KEYS, "source", lambda t: ~t.exact & (t.mae < NEAR)).select(*KEYS, "source1", "source2", "n_shared", "mae"))


TUPLES = "tu AS (SELECT solute, solvent, round_even(t, 1) AS t, round_even(y, 2) AS y, count(*) AS n, list_sort(list(DISTINCT source)) AS sources, count(DISTINCT source) AS n_sources FROM m GROUP BY ALL HAVING count(DISTINCT source) >= 2)"


def _tuples(spark, sf):
    return audit.equal_tuples(measurements(spark, sf), "solute", "solvent", "t", "y", "source", y_digits=2)


@query(rounded_sql(TUPLES, "SELECT solute, solvent, t, y, n, array_to_string(sources, '|') AS sources, n_sources FROM tu", "t y"))
def bitexact_tuples(spark, sf):
    return rounded(_tuples(spark, sf).withColumn("sources", F.array_join("sources", "|")))


@query(rounded_sql(TUPLES, "SELECT solute, count(*) AS n, max(n_sources) AS most FROM tu GROUP BY solute"))
def set_valued_sources(spark, sf):
    return _tuples(spark, sf).groupBy("solute").agg(F.count(F.lit(1)).alias("n"), F.max("n_sources").alias("most"))


@query(rounded_sql(TUPLES + ", u AS (SELECT row_number() OVER () AS k, sources FROM tu), v AS (SELECT k, unnest(sources) AS s FROM u)", "SELECT a.s AS source1, b.s AS source2, count(*) AS n FROM v a JOIN v b ON a.k = b.k AND a.s < b.s GROUP BY 1, 2 ORDER BY n DESC, source1, source2 LIMIT 20"))
def pair_counter_topk(spark, sf):
    return audit.shared_tuples(_tuples(spark, sf))


GROUPS = """e AS (SELECT source1 AS a, source2 AS b FROM c UNION SELECT source2, source1 FROM c),
  reach(node, root) AS (SELECT DISTINCT source, source FROM m UNION SELECT e.b, reach.root FROM reach JOIN e ON reach.node = e.a)"""


@query(rounded_sql(COPIES + ", " + GROUPS, "SELECT node AS source, min(root) AS group_id FROM reach GROUP BY node").replace("WITH m AS", "WITH RECURSIVE m AS", 1))
def independence_groups(spark, sf):
    rows = _rows(spark, sf)
    return audit.independence_groups(blocks.copy_edges(rows, KEYS, "source", NEAR), measurements(spark, sf), "source")


FINE = "f AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.solute = p.solute AND c.solvent = p.solvent AND c.source1 = p.source1 AND c.source2 = p.source2))"
RELIABILITY = COPIES + ", " + FINE + """, h AS (SELECT solute, solvent, t, source1 AS source, y1 AS y, y2 AS o FROM f UNION ALL SELECT solute, solvent, t, source2, y2, y1 FROM f),
  dev AS (SELECT solute, solvent, t, source, abs(y - median(o)) AS d FROM h GROUP BY solute, solvent, t, source, y),
  rel AS (SELECT source, count(DISTINCT (solute, solvent)) AS n_pairs, count(*) AS n_comparisons, avg(d) AS mae, median(d) AS median_dev, max(d) AS max_dev, stddev_pop(d) AS std_dev FROM dev GROUP BY source)"""


@query(rounded_sql(RELIABILITY, "SELECT * FROM rel", "mae median_dev max_dev std_dev"))
def source_reliability(spark, sf):
    return rounded(blocks.source_reliability(_rows(spark, sf), KEYS, "source", NEAR))


@query(rounded_sql(RELIABILITY, "SELECT source, mae, CASE WHEN mae <= 13e-2 THEN 'fame' ELSE 'shame' END AS kind FROM rel WHERE mae <= 13e-2 OR mae >= 16e-2", "mae"))
def hall_of_fame(spark, sf):
    return rounded(audit.fame(blocks.source_reliability(_rows(spark, sf), KEYS, "source", NEAR), 0.13, 0.16).select("source", "mae", "kind"))


VARIABILITY = COPIES + ", " + SPANS + ", " + FINE + """, g AS (SELECT f.* FROM f JOIN sp a ON a.solute = f.solute AND a.solvent = f.solvent AND a.source = f.source1 JOIN sp b ON b.solute = f.solute AND b.solvent = f.solvent AND b.source = f.source2
  WHERE a.hi - b.lo >= 2 OR b.hi - a.lo >= 2 OR a.n <= 1 OR b.n <= 1),
  var AS (SELECT solute, solvent, count(DISTINCT (source1, source2)) AS n_pairs, count(*) AS n_comparisons, avg(abs(y1 - y2)) AS mae, sqrt(avg((y1 - y2) * (y1 - y2))) AS rmse, stddev_pop(y1 - y2) AS std, max(abs(y1 - y2)) AS max_dev FROM g GROUP BY ALL),
  ns AS (SELECT solute, solvent, count(DISTINCT s) AS n_sources FROM (SELECT solute, solvent, source1 AS s FROM g UNION ALL SELECT solute, solvent, source2 FROM g) GROUP BY ALL), vr AS (SELECT * FROM var JOIN ns USING (solute, solvent))"""


def _variability(spark, sf):
    return blocks.variability(_rows(spark, sf), KEYS, "source", NEAR)


@query(rounded_sql(VARIABILITY, "SELECT * FROM vr", "mae rmse std max_dev"))
def variability_direct(spark, sf):
    return rounded(_variability(spark, sf))


@query(rounded_sql(VARIABILITY + ", st AS (SELECT mae, CASE WHEN n_sources >= 5 THEN 'ge5' WHEN n_sources >= 3 THEN 's3_4' WHEN n_sources = 2 THEN 's2' END AS stratum FROM vr UNION ALL SELECT mae, 'all' FROM vr)",
    "SELECT stratum, count(*) AS n, avg(mae) AS mean, median(mae) AS median, stddev_pop(mae) AS std, quantile_cont(mae, 25e-2) AS p25, quantile_cont(mae, 75e-2) AS p75, quantile_cont(mae, 9e-1) AS p90, sqrt(avg(mae * mae)) AS rmse FROM st WHERE stratum IS NOT NULL GROUP BY stratum", "mean median std p25 p75 p90 rmse"))
def stratified_limit(spark, sf):
    return rounded(audit.stratified_limit(_variability(spark, sf)))


@query(rounded_sql(POINTS, "SELECT count(*) AS n, avg(y1 - y2) AS mean, stddev_pop(y1 - y2) AS std, avg(CASE WHEN abs(y1 - y2) <= 5e-2 THEN 1e0 ELSE 0e0 END) AS within_0, avg(CASE WHEN abs(y1 - y2) <= 2e-1 THEN 1e0 ELSE 0e0 END) AS within_1 FROM p", "mean std within_0 within_1"))
def bias_decomposition(spark, sf):
    return rounded(audit.bias(_points(spark, sf), [0.05, 0.2]))


@query(rounded_sql(POINTS, "SELECT cutoff, count(*) AS n, avg(abs(y1 - y2)) AS mean, median(abs(y1 - y2)) AS median FROM p, (VALUES (0e0), (1e-2), (5e-2), (1e-1)) k(cutoff) WHERE abs(y1 - y2) >= cutoff GROUP BY cutoff", "cutoff mean median"))
def cutoff_sensitivity(spark, sf):
    return rounded(spreads.cutoff_sensitivity(_values(spark, sf), [0.0, 0.01, 0.05, 0.1]))


BOOT = """b0 AS (SELECT solute, solvent, avg(y) AS v FROM m GROUP BY ALL), b AS (SELECT *, row_number() OVER (ORDER BY solute, solvent) - 1 AS i, count(*) OVER () AS n FROM b0),
  draws AS (SELECT r.b, cast('0x' || substr(md5(concat_ws('|', '42', r.b, j.j)), 1, 8) AS bigint) % (SELECT any_value(n) FROM b) AS i FROM range(100) r(b), (SELECT i AS j FROM b) j),
  means AS (SELECT draws.b, avg(v) AS mm FROM draws JOIN b ON draws.i = b.i GROUP BY draws.b)"""


@query(rounded_sql(BOOT, "SELECT (SELECT count(*) FROM b) AS n, (SELECT avg(v) FROM b) AS value, quantile_cont(mm, 25e-3) AS low, quantile_cont(mm, 975e-3) AS high FROM means", "value low high"))
def bootstrap_ci(spark, sf):
    return rounded(audit.bootstrap(measurements(spark, sf).groupBy(*KEYS).agg(F.avg("y").alias("v")), KEYS, "v", 100))


@query(rounded_sql(BOOT.replace("avg(v) AS mm", "median(v) AS mm"), "SELECT (SELECT count(*) FROM b) AS n, (SELECT median(v) FROM b) AS value, quantile_cont(mm, 25e-3) AS low, quantile_cont(mm, 975e-3) AS high FROM means", "value low high"))
def bootstrap_median_ci(spark, sf):
    return rounded(audit.bootstrap(measurements(spark, sf).groupBy(*KEYS).agg(F.avg("y").alias("v")), KEYS, "v", 100, statistic=F.median))


# --- fits, consensus, tiers ---------------------------------------------------------------------------------------------


def fit_sql(name: str, source: str, keys: str, y: str = "y") -> str:
    """Common table expressions <name>: closed-form fits, the same algebra in SQL."""
    return f"""{name}1 AS (SELECT {keys}, t, {y} AS y, 1000e0 / t AS u, ln(t) AS w FROM {source} WHERE t IS NOT NULL AND {y} IS NOT NULL),
  {name}2 AS (SELECT *, u - avg(u) OVER k AS du, w - avg(w) OVER k AS dw, y - avg(y) OVER k AS dy, avg(u) OVER k AS mu, avg(w) OVER k AS mw, avg(y) OVER k AS my FROM {name}1 WINDOW k AS (PARTITION BY {keys})),
  {name}3 AS (SELECT {keys}, count(*) AS n_points, min(t) AS t_min, max(t) AS t_max, any_value(mu) AS u_mean, any_value(mw) AS w_mean, any_value(my) AS my, sum(du * du) AS uu, sum(dw * dw) AS ww, sum(du * dw) AS uw, sum(du * dy) AS uy, sum(dw * dy) AS wy, sum(dy * dy) AS yy FROM {name}2 GROUP BY {keys}),
  {name}4 AS (SELECT *, uu * ww - uw * uw AS det, (uy * ww - wy * uw) / (uu * ww - uw * uw) AS bu, (wy * uu - uy * uw) / (uu * ww - uw * uw) AS c FROM {name}3 WHERE n_points >= 3 AND uu * ww - uw * uw > 1e-12 * uu * ww),
  {name}5 AS (SELECT *, my - bu * u_mean - c * w_mean AS a, 1000 * bu AS b, greatest(0e0, yy - bu * uy - c * wy) AS sse FROM {name}4),
  {name} AS (SELECT {keys}, n_points, a, b, c, CASE WHEN yy > 0 THEN 1 - sse / yy ELSE 0e0 END AS r2, sqrt(sse / n_points) AS rmse, t_min, t_max, CASE WHEN n_points > 3 THEN sse / (n_points - 3) END AS s2, u_mean, w_mean,
    CASE WHEN n_points > 3 THEN sse / (n_points - 3) * ww / det END AS cuu, CASE WHEN n_points > 3 THEN sse / (n_points - 3) * uu / det END AS cww, CASE WHEN n_points > 3 THEN -sse / (n_points - 3) * uw / det END AS cuw FROM {name}5)"""


FITS = fit_sql("fit", "m", "solute, solvent, source")
TRIPLE = [*KEYS, "source"]


def _fits(spark, sf):
    return fits.apelblat_fits(measurements(spark, sf), TRIPLE, "t", "y")


@query(rounded_sql(FITS, "SELECT solute, solvent, source, n_points, a + b / 290e0 + c * ln(290e0) AS y290, a + b / 310e0 + c * ln(310e0) AS y310, r2, rmse, t_min, t_max FROM fit", "y290 y310 r2 rmse t_min t_max", 4))
def apelblat_fit(spark, sf):
    at = lambda t: fits.curve_at(F.lit(t))
    return rounded(_fits(spark, sf).select(*TRIPLE, "n_points", at(290.0).alias("y290"), at(310.0).alias("y310"), "r2", "rmse", "t_min", "t_max"), 4)


@query(rounded_sql("", "SELECT solute, solvent, source, count(*) AS n_points, regr_intercept(y, 1000e0 / t) AS a, 1000 * regr_slope(y, 1000e0 / t) AS b, coalesce(regr_r2(y, 1000e0 / t), 1e0) AS r2, min(t) AS t_min, max(t) AS t_max FROM m GROUP BY ALL HAVING max(t) > min(t)", "a b r2 t_min t_max", 4))
def vanthoff_fit(spark, sf):
    return rounded(fits.vanthoff_fits(measurements(spark, sf), TRIPLE, "t", "y"), 4)


@query(rounded_sql("k AS (SELECT seed, solute, solvent, source, count(*) AS n_points, CASE WHEN count(DISTINCT t) >= 3 THEN 'apelblat' WHEN count(DISTINCT t) = 2 AND count(t) = 2 THEN 'vanthoff' WHEN count(t) = 1 THEN 'isolated' ELSE 'failed' END AS model FROM m GROUP BY ALL)", "SELECT model, count(*) AS groups, cast(sum(n_points) AS bigint) AS points FROM k GROUP BY model"))
def fit_taxonomy(spark, sf):
    k = fits.taxonomy(measurements(spark, sf), ["seed", *TRIPLE], "t")
    return k.groupBy("model").agg(F.count(F.lit(1)).alias("groups"), F.sum("n_points").alias("points"))


HALF = "196e-2 * sqrt(greatest(0e0, s2 / n_points + (1000e0 / {t} - u_mean) * (1000e0 / {t} - u_mean) * cuu + (ln({t}) - w_mean) * (ln({t}) - w_mean) * cww + 2 * (1000e0 / {t} - u_mean) * (ln({t}) - w_mean) * cuw))"


@query(rounded_sql(FITS, f"SELECT solute, solvent, source, {HALF.format(t='298.15e0')} AS ci FROM fit", "ci", 4))
def curve_eval_ci(spark, sf):
    return rounded(_fits(spark, sf).select(*TRIPLE, fits.half_width_at(F.lit(298.15)).alias("ci")), 4)


@query(rounded_sql(FITS, "SELECT solute, solvent, source, a + b / 298.15e0 + c * ln(298.15e0) AS y FROM fit WHERE r2 >= 8e-1 AND rmse <= 3e-1 AND t_min <= 298.15e0 AND t_max >= 298.15e0", "y", 5))
def interp_at_target(spark, sf):
    return rounded(fits.at_temperature(_fits(spark, sf), least_r2=0.8).select(*TRIPLE, "y"), 5)


GOOD_FITS = "good AS (SELECT * FROM fit WHERE r2 > 5e-1 AND s2 IS NOT NULL)"


def interpolated_sql(good: str, name: str) -> str:
    """Common table expression <name>: disagreement of the curves in ``good`` by group."""
    return f"""{name}s AS (SELECT solute, solvent, max(t_min) AS lo, min(t_max) AS hi FROM {good} GROUP BY ALL HAVING count(*) >= 2 AND max(t_min) <= min(t_max)),
  {name}g AS (SELECT solute, solvent, unnest(CASE WHEN ceil(lo / 5) * 5 <= floor(hi / 5) * 5 THEN list_transform(range(cast(ceil(lo / 5) * 5 AS int), cast(floor(hi / 5) * 5 AS int) + 1, 5), lambda x: cast(x AS double)) ELSE [(lo + hi) / 2] END) AS t FROM {name}s),
  {name}t AS (SELECT z.solute, z.solvent, source, t, a + b / t + c * ln(t) AS y, {HALF.format(t='t')} AS ci FROM {good} z JOIN {name}g USING (solute, solvent)),
  {name}p AS (SELECT a.solute, a.solvent, a.t, a.source AS source1, b.source AS source2, a.y AS y1, b.y AS y2 FROM {name}t a JOIN {name}t b ON a.solute = b.solute AND a.solvent = b.solvent AND a.t = b.t AND a.source < b.source WHERE a.ci < 5e-1 AND b.ci < 5e-1),
  {name} AS (SELECT solute, solvent, count(*) AS n_comparisons, avg(abs(y1 - y2)) AS mae, sqrt(avg((y1 - y2) * (y1 - y2))) AS rmse, stddev_pop(y1 - y2) AS std, max(abs(y1 - y2)) AS max_dev FROM {name}p GROUP BY ALL)"""


INTERPOLATED = FITS + ", " + GOOD_FITS + ", " + interpolated_sql("good", "iv")


def _interpolated(spark, sf):
    points = fits.interpolated(_fits(spark, sf), KEYS, "source", pairs.reference_grid, 0.5, 0.5)
    return points.groupBy(*KEYS).agg(*audit.error_summary(F.col("y1") - F.col("y2")))


@query(rounded_sql(INTERPOLATED, "SELECT * FROM iv", "mae rmse std max_dev", 5))
def variability_interpolated(spark, sf):
    return rounded(_interpolated(spark, sf), 5)


@query(rounded_sql(INTERPOLATED + ", " + VARIABILITY, "SELECT d, i, sqrt(d * d + 2 * i * i) AS composite FROM (SELECT (SELECT median(mae) FROM vr) AS d, (SELECT median(mae) FROM iv) AS i)", "d i composite", 5))
def composite_limit(spark, sf):
    rows = _rows(spark, sf, fitted=True)
    between = fits.disagreement(fits.predicted(fits.good_fits(fits.solved(rows, TRIPLE), 0.5), KEYS, "source", pairs.reference_grid, 0.5), KEYS, "source")
    return rounded(audit.composite_limit(blocks.variability(rows, KEYS, "source", NEAR), "mae", between, "mae").select(F.col("direct").alias("d"), F.col("between").alias("i"), "composite"), 5)


# the interpolated branch is of fitted sources that aren't copies of all others
ASSEMBLED = VARIABILITY + ", " + FITS + ", " + GOOD_FITS + """, gn AS (SELECT solute, solvent, count(*) AS gn FROM good GROUP BY ALL),
  cp AS (SELECT solute, solvent, source1 AS source, source2 AS other FROM c UNION SELECT solute, solvent, source2, source1 FROM c),
  cc AS (SELECT cp.solute, cp.solvent, cp.source, count(*) AS k FROM cp JOIN good a ON a.solute = cp.solute AND a.solvent = cp.solvent AND a.source = cp.source JOIN good b ON b.solute = cp.solute AND b.solvent = cp.solvent AND b.source = cp.other GROUP BY ALL),
  gi AS (SELECT good.* FROM good JOIN gn USING (solute, solvent) LEFT JOIN cc USING (solute, solvent, source) WHERE coalesce(k, 0) < gn - 1), """ + interpolated_sql("gi", "ix") + """,
  vb AS (SELECT solute, solvent, 'direct' AS method, n_comparisons, mae, rmse, std, max_dev FROM vr WHERE (solute, solvent) NOT IN (SELECT (solute, solvent) FROM gn WHERE gn >= 2)
    UNION ALL SELECT solute, solvent, 'interpolated', n_comparisons, mae, rmse, std, max_dev FROM ix)"""


def _assembled(spark, sf, rows=None):
    """Disagreement of each group's sources: of curves where two are fitted, else of readings. Only the latter groups' readings are paired."""
    rows = rows or _rows(spark, sf, fitted=True)
    good = fits.good_fits(fits.solved(rows, TRIPLE), 0.5)
    groups = materialise(fits.fitted_groups(good, KEYS))
    few = F.broadcast(groups) if groups.count() <= blocks.SMALL else groups
    direct = blocks.variability(rows.join(few, KEYS, "left_anti"), KEYS, "source", NEAR)
    same = blocks.copies_of_all(good.join(few, KEYS, "left_semi").select(*TRIPLE, "ts", "ys", "lo", "hi", "n"), KEYS, "source", NEAR)
    told = fits.predicted(good.join(few, KEYS, "left_semi").join(F.broadcast(same) if same.count() <= blocks.SMALL else same, TRIPLE, "left_anti"), KEYS, "source", pairs.reference_grid, 0.5)
    return audit.variability(direct, fits.disagreement(told, KEYS, "source"), groups, KEYS)


@query(rounded_sql(ASSEMBLED, "SELECT * FROM vb", "mae rmse std max_dev", 5))
def variability(spark, sf):
    return rounded(_assembled(spark, sf), 5)


def consensus_sql(rows: str, group: str) -> str:
    """Common table expression con: labels of ``rows``, with ``group`` as the independence group."""
    return fit_sql("cf", rows, f"solute, solvent, {group}") + f""", cg AS (SELECT * FROM cf WHERE r2 >= 8e-1 AND rmse <= 3e-1), ft AS (SELECT solute, solvent, max(t_min) AS lo, min(t_max) AS hi FROM cg GROUP BY ALL HAVING count(*) >= 2),
  ms AS (SELECT DISTINCT z.solute, z.solvent, z.t, lo, hi FROM {rows} z JOIN ft USING (solute, solvent)), ni AS (SELECT *, count(*) FILTER (t >= lo AND t <= hi) OVER (PARTITION BY solute, solvent) AS n_in FROM ms),
  cv AS (SELECT ni.solute, ni.solvent, ni.t, {group} AS g, a + b / ni.t + c * ln(ni.t) AS v, 'curve' AS method FROM ni JOIN cg USING (solute, solvent) WHERE ((ni.t >= lo AND ni.t <= hi) OR n_in = 0) AND ni.t >= t_min AND ni.t <= t_max),
  md AS (SELECT solute, solvent, t, {group} AS g, median(y) AS v, 'direct' AS method FROM {rows} WHERE (solute, solvent) NOT IN (SELECT (solute, solvent) FROM ft) GROUP BY solute, solvent, t, {group}),
  con AS (SELECT solute, solvent, t, method, avg(v) AS value, count(v) AS n_sources, CASE WHEN count(v) > 1 THEN stddev_pop(v) END AS sigma, array_to_string(list_sort(list(DISTINCT g)), '|') AS groups FROM (SELECT * FROM cv UNION ALL SELECT * FROM md) GROUP BY ALL)"""


GROUPED = GROUPS + ", grp AS (SELECT node AS source, min(root) AS g FROM reach GROUP BY node), mg AS (SELECT m.*, grp.g FROM m JOIN grp USING (source))"
CONSENSUS = GROUPED + ", " + consensus_sql("mg", "g")


def _grouped(spark, sf, rows):
    """Readings with the independence group of their source, from rows with ``whole`` readings."""
    groups = materialise(audit.independence_groups(blocks.copy_edges(rows, KEYS, "source", NEAR), rows, "source").withColumnRenamed("group_id", "g"))
    read = rows.select(*KEYS, "source", "xs", "zs").join(small(groups), "source")
    return read.select(*KEYS, "g", F.explode(F.arrays_zip("xs", "zs")).alias("r")).select(*KEYS, "g", F.col("r.xs").alias("t"), F.col("r.zs").alias("y"))


@query(rounded_sql(COPIES + ", " + CONSENSUS, "SELECT * FROM con", "t value sigma", 4).replace("WITH m AS", "WITH RECURSIVE m AS", 1))
def consensus_labels(spark, sf):
    labels = tiers.consensus(_grouped(spark, sf, _rows(spark, sf, whole=True)), KEYS, "g", "t", "y")
    return rounded(labels.withColumn("groups", F.array_join("groups", "|")), 4)


TIER = ASSEMBLED + ", tr AS (SELECT solute, solvent, mae, tier FROM vb, (VALUES ('gold', 1e-1), ('silver', 2e-1), ('bronze', 5e-1)) k(tier, lim) WHERE mae >= 2e-2 AND mae <= lim)"


@query(rounded_sql(TIER, "SELECT * FROM tr", "mae", 5))
def tier_membership(spark, sf):
    return rounded(tiers.tier_membership(_assembled(spark, sf).select(*KEYS, "mae")), 5)


@query(rounded_sql(TIER + ", " + CONSENSUS + ", told AS (SELECT solute, solvent, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources FROM m GROUP BY ALL)",
    "SELECT tier, solute, solvent, t, method, value, con.n_sources, sigma, groups, mae AS interlab_mae, sources FROM con JOIN tr USING (solute, solvent) JOIN told USING (solute, solvent)", "t value sigma interlab_mae", 4).replace("WITH m AS", "WITH RECURSIVE m AS", 1))
def tier_rows(spark, sf):
    """Every label of every tier."""
    sources = _rows(spark, sf, fitted=True, whole=True)
    labels = tiers.consensus(_grouped(spark, sf, sources), KEYS, "g", "t", "y").withColumn("groups", F.array_join("groups", "|"))
    return rounded(tiers.tier_rows(labels, tiers.tier_membership(_assembled(spark, sf, sources).select(*KEYS, "mae")), KEYS, sources, "source"), 4)


@query()
def bounded_fit(spark, sf):
    return fits.bounded_fits(measurements(spark, sf, "raw"), TRIPLE, "t", "y")


@query()
def distribution_fit(spark, sf):
    return spreads.distribution_fits(_values(spark, sf))


# --- metrics and roll-ups -----------------------------------------------------------------------------------------------

TRAIN = "h AS (SELECT *, cast('0x' || substr(md5(rid), 1, 8) AS bigint) % 2 = 0 AS train FROM m)"
PRED = TRAIN + ", gm AS (SELECT solvent, avg(y) AS gm FROM h WHERE train GROUP BY solvent), pr AS (SELECT h.*, coalesce(gm, (SELECT avg(y) FROM h WHERE train)) AS pred FROM h LEFT JOIN gm USING (solvent) WHERE NOT train)"
SUITE = """SELECT flag, cast(sum(n) AS bigint) AS n, sqrt(sum(sse) / sum(n)) AS rmse, sum(sae) / sum(n) AS mae, any_value(r2) AS r2, avg(sqrt(sse / n)) FILTER (n >= 2) AS ps_rmse, avg(1 - sse / (n * v)) FILTER (n >= 2 AND v > 0) AS ps_r2, count(*) FILTER (n >= 2) AS n_solvents,
  sqrt(sum(zz) / sum(nz)) AS z_rmse, sum(ins) / sum(nz) AS f_aleatoric, cast(sum(nz) AS bigint) AS n_uncertain FROM (SELECT flag, solvent, count(*) AS n, sum((y - pred) * (y - pred)) AS sse, sum(abs(y - pred)) AS sae, var_pop(y) AS v, sum(pow((y - pred) / greatest(sigma, 1e-2), 2)) FILTER (sigma IS NOT NULL) AS zz, count(sigma) AS nz,
  count(*) FILTER (abs(y - pred) <= 2 * sigma) AS ins FROM pr GROUP BY 1, 2) JOIN (SELECT flag, 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) AS r2 FROM pr GROUP BY 1) USING (flag) GROUP BY flag"""
SUITE_DOUBLES = "rmse mae r2 ps_rmse ps_r2 z_rmse f_aleatoric"


def _halved(spark, sf):
    rows = measurements(spark, sf, "raw")
    half = F.pmod(F.conv(F.substring(F.md5("rid"), 1, 8), 16, 10).cast("long"), F.lit(2)) == 0
    return rows.where(half), rows.where(~half)


def _predicted(spark, sf):
    train, test = _halved(spark, sf)
    return metrics.dummy_baseline(train, test, "solvent", "y")


@query(rounded_sql(PRED, SUITE, SUITE_DOUBLES, view=RAW))
def metric_suite(spark, sf):
    return rounded(metrics.metric_suite(_predicted(spark, sf), "flag", "solvent", "y", "pred", "sigma"))


@query(rounded_sql(PRED, "SELECT flag, median(abs(y - pred)) AS medae, avg(100 * abs(y - pred) / abs(y)) FILTER (abs(y) > 1e-2) AS mape FROM pr GROUP BY flag", "medae mape", view=RAW))
def metric_medae_mape(spark, sf):
    return rounded(metrics.robust_errors(_predicted(spark, sf), "flag", "y", "pred"))


@query(rounded_sql(PRED, "SELECT rid, pred FROM pr", "pred", view=RAW))
def dummy_baseline(spark, sf):
    return rounded(_predicted(spark, sf).select("rid", "pred"))


@query(rounded_sql("g AS (SELECT solvent, count(y) AS n, avg(y) AS a, var_pop(y) AS v FROM m GROUP BY solvent), s AS (SELECT count(*) AS k, cast(sum(n) AS bigint) AS n, sum(n * pow(a - (SELECT avg(y) FROM m), 2)) AS ssb, sum(n * v) AS ssw FROM g)", "SELECT k, n, ssb / (ssb + ssw) AS share, ssb * (n - k) / (ssw * (k - 1)) AS f FROM s", "share f"))
def anova_between(spark, sf):
    return rounded(metrics.anova(measurements(spark, sf), "solvent", "y"))


FLOOR = "d AS (SELECT solute, solvent, round_even(t, 0) AS tr, y - avg(y) OVER k AS d, count(*) OVER k AS n, y FROM m WINDOW k AS (PARTITION BY solute, solvent, round_even(t, 0))), fg AS (SELECT solute, solvent, tr, sum(d * d) AS ss, sum(abs(d)) AS sa, count(*) AS n, stddev_samp(y) AS s FROM d WHERE n >= 2 GROUP BY ALL)"


@query(rounded_sql(FLOOR, "SELECT count(*) AS n_groups, cast(sum(n) AS bigint) AS n_rows, sqrt(sum(ss) / sum(n)) AS rms, sum(sa) / sum(n) AS mae, quantile_cont(s, 5e-1) AS p50, quantile_cont(s, 9e-1) AS p90, quantile_cont(s, 99e-2) AS p99, max(s) AS most FROM fg", "rms mae p50 p90 p99 most"))
def duplicate_floor(spark, sf):
    return rounded(metrics.duplicate_floor(measurements(spark, sf), KEYS, "t", "y"))


@query(rounded_sql("", "SELECT sqrt(avg(sigma * sigma)) AS sigma_rms, count(sigma) AS n FROM m WHERE sigma > 0", "sigma_rms"))
def sigma_floor(spark, sf):
    return rounded(metrics.sigma_floor(measurements(spark, sf), "sigma"))


@query(rounded_sql(FLOOR, "SELECT sqrt(sum(ss) / sum(n)) AS floor, 'duplicates' AS kind FROM fg", "floor"))
def preferred_floor(spark, sf):
    rows = measurements(spark, sf)
    return rounded(metrics.preferred_floor(metrics.duplicate_floor(rows, KEYS, "t", "y"), metrics.sigma_floor(rows, "sigma")))


@query(rounded_sql(TRAIN + ", o AS (SELECT solute, solvent, avg(y - x) AS off FROM h WHERE train GROUP BY ALL)", "SELECT rid, coalesce(off, 0e0) AS \"offset\", x + coalesce(off, 0e0) AS corrected FROM h LEFT JOIN o USING (solute, solvent) WHERE NOT train", '"offset" corrected', view=RAW))
def pair_offsets(spark, sf):
    train, test = _halved(spark, sf)
    return rounded(metrics.pair_offsets(train, test, KEYS, "y", "x").select("rid", "offset", "corrected"))


@query(rounded_sql("", "SELECT solute, solvent, avg(y - x) AS mean_error, stddev_samp(y - x) AS std_error, count(y - x) AS n, avg(y) AS mean_y, avg(x) AS mean_pred FROM m GROUP BY ALL", "mean_error std_error mean_y mean_pred"))
def error_stats(spark, sf):
    return rounded(metrics.error_stats(measurements(spark, sf), KEYS, "y", "x"))


@query(rounded_sql(TRAIN + ", o AS (SELECT solvent, avg(y - (1e-1 + 5e-1 * x + 1e-2 * weight)) AS bias FROM h WHERE train GROUP BY ALL)", "SELECT rid, 1e-1 + 5e-1 * x + 1e-2 * weight + bias AS pred FROM h JOIN o USING (solvent) WHERE NOT train", "pred", view=RAW))
def free_energy_predictor(spark, sf):
    from tarnwick.functions.scalar import free_energy

    raw = free_energy([(F.lit(0.5), F.col("x")), (F.lit(0.01), F.col("weight"))], F.lit(0.1))
    train, test = _halved(spark, sf)
    return rounded(metrics.biased_predictor(train.withColumn("raw", raw), test.withColumn("raw", raw), "solvent", "y", "raw").select("rid", "pred"))


@query(rounded_sql("""g AS (SELECT solute, solvent, t, avg(y) AS y FROM m GROUP BY ALL), n AS (SELECT *, lag(y) OVER k AS y0, lead(y) OVER k AS y2, t - lag(t) OVER k AS h1, lead(t) OVER k - t AS h2 FROM g WINDOW k AS (PARTITION BY solute, solvent ORDER BY t)),
  q AS (SELECT solute, solvent, t, CASE WHEN h1 IS NOT NULL AND h2 IS NOT NULL THEN (h1 * h1 * y2 + (h2 * h2 - h1 * h1) * y - h2 * h2 * y0) / (h1 * h2 * (h1 + h2)) WHEN h2 IS NOT NULL THEN (y2 - y) / h2 WHEN h1 IS NOT NULL THEN (y - y0) / h1 END AS gradient FROM n)""", "SELECT * FROM q WHERE gradient > 0 AND gradient < 1", "t gradient"))
def gradient_targets(spark, sf):
    return rounded(metrics.gradients(measurements(spark, sf), KEYS, "t", "y"))


LONG = "e2 AS (SELECT flag, seed, solvent, sqrt(avg((y - x) * (y - x))) AS rmse, avg(abs(y - x)) AS mae FROM m GROUP BY ALL), lo AS (SELECT flag, seed, solvent, 'rmse' AS metric, rmse AS value FROM e2 UNION ALL SELECT flag, seed, solvent, 'mae', mae FROM e2), ro AS (SELECT solvent, flag, metric, avg(value) AS mean, stddev_pop(value) AS std, count(value) AS n FROM lo GROUP BY ALL)"


def _rolled(spark, sf):
    e = F.col("y") - F.col("x")
    runs = measurements(spark, sf).groupBy("flag", "seed", "solvent").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    long = runs.select("flag", "seed", "solvent", F.explode(F.create_map(F.lit("rmse"), "rmse", F.lit("mae"), "mae")).alias("metric", "value"))
    return rollup.seed_rollup(long, ["solvent", "flag", "metric"])


@query(rounded_sql(LONG, "SELECT * FROM ro", "mean std"))
def seed_rollup(spark, sf):
    return rounded(_rolled(spark, sf))


WIDE = ", ".join(f"max({c}) FILTER (flag = '{s}' AND metric = '{m}') AS {s}_{m}_{c}" for s in "AR" for m in ("rmse", "mae") for c in ("mean", "std"))
WIDE_NAMES = " ".join(f"{s}_{m}_{c}" for s in "AR" for m in ("rmse", "mae") for c in ("mean", "std"))


@query(rounded_sql(LONG, f"SELECT solvent, {WIDE} FROM ro GROUP BY solvent", WIDE_NAMES))
def wide_results(spark, sf):
    return rounded(rollup.wide_results(_rolled(spark, sf), ["solvent"], "flag", "metric", ["A", "R"], ["rmse", "mae"]))


@query(rounded_sql(LONG + ", c AS (SELECT DISTINCT solvent FROM ro)", "SELECT solvent, coalesce(list_position(['NATION_7', 'NATION_3', 'NATION_12'], solvent), 0)::BIGINT AS position FROM c"))
def custom_order(spark, sf):
    return rollup.ordered_by(_rolled(spark, sf).select("solvent").distinct(), "solvent", ["NATION_7", "NATION_3", "NATION_12"]).na.fill(0, ["position"])


@query(rounded_sql("c AS (SELECT flag, seed, count(*) AS n, avg(abs(y - x)) AS v FROM m GROUP BY ALL)", "SELECT flag, cast(seed AS double) / 10 AS fraction, max(n) AS n, avg(v) AS mean FROM c GROUP BY ALL", "fraction mean"))
def learning_curve(spark, sf):
    runs = measurements(spark, sf).groupBy("flag", "seed").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y") - F.col("x"))).alias("v"))
    return rounded(rollup.learning_curve(runs.withColumn("fraction", F.col("seed").cast("double") / 10), ["flag"], "fraction", "n", "v"))


@query(rounded_sql(LONG + ", d2 AS (SELECT solvent, max(mean) FILTER (flag = 'A') AS easy, max(mean) FILTER (flag = 'R') AS hard FROM ro WHERE metric = 'mae' GROUP BY solvent)", "SELECT solvent, easy, hard, hard - easy AS delta, 100 * (hard - easy) / easy AS percent FROM d2 WHERE easy IS NOT NULL AND hard IS NOT NULL", "easy hard delta percent"))
def tier_degradation(spark, sf):
    return rounded(rollup.degradation(_rolled(spark, sf).where("metric = 'mae'"), "solvent", "flag", "mean", "A", "R"))


@query(rounded_sql(LONG + ", d2 AS (SELECT solvent, max(mean) FILTER (flag = 'A') AS a, max(mean) FILTER (flag = 'N') AS b FROM ro WHERE metric = 'rmse' GROUP BY solvent)", "SELECT solvent, a AS \"first\", b AS \"second\", CASE WHEN a < b THEN 'A' WHEN b < a THEN 'N' ELSE 'tie' END AS winner FROM d2 WHERE a IS NOT NULL AND b IS NOT NULL", '"first" "second"'))
def paired_variants(spark, sf):
    return rounded(rollup.paired_variants(_rolled(spark, sf).where("metric = 'rmse'"), "solvent", "flag", "mean", "A", "N"))


@query(rounded_sql(LONG, "SELECT solvent, mean, row_number() OVER (ORDER BY mean NULLS LAST, solvent) AS rank FROM ro WHERE metric = 'rmse' AND flag = 'A'", "mean"))
def metric_ranking(spark, sf):
    return rounded(rollup.ranking(_rolled(spark, sf).where("metric = 'rmse' and flag = 'A'").select("solvent", "mean"), "solvent", "mean"))


IMPORTANCE = FEATURES + ", im AS (SELECT pos, CASE WHEN pos < 24 THEN 'solute' WHEN pos < 56 THEN 'solvent' ELSE 't' END AS block, avg(abs(v)) AS mean_abs, avg(v) AS mean FROM e GROUP BY 1, 2)"


def _importance(spark, sf):
    block = F.when(F.col("pos") < 24, "solute").when(F.col("pos") < 56, "solvent").otherwise("t")
    return rollup.importance(_features(spark, sf).withColumn("block", block), "pos", "v", "block")


@query(f"WITH {IMPORTANCE} SELECT pos, block, round(mean_abs, 6) + 0e0 AS mean_abs, round(mean, 6) + 0e0 AS mean, row_number() OVER (ORDER BY mean_abs DESC, pos) AS rank FROM im")
def importance_rank(spark, sf):
    return rounded(_importance(spark, sf))


@query(f"WITH {IMPORTANCE} SELECT block, round(sum(mean_abs), 6) AS total, round(sum(mean_abs) / (SELECT sum(mean_abs) FROM im), 6) AS share FROM im GROUP BY block")
def block_share(spark, sf):
    return rounded(rollup.block_shares(_importance(spark, sf), "block"))


@query(f"""WITH {FEATURES}, k AS (SELECT label FROM e GROUP BY label HAVING count(*) >= 5 ORDER BY count(*) DESC, label LIMIT 5), g AS (SELECT label, pos, avg(abs(v)) AS mean_abs FROM e WHERE label IN (SELECT label FROM k) GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mean_abs DESC, pos) AS rank FROM g) SELECT label, pos, round(mean_abs, 6) AS mean_abs, rank FROM r WHERE rank <= 5""")
def importance_by_group(spark, sf):
    return rounded(rollup.group_importance(_features(spark, sf), "label", "pos", "v", 5))


@query(f"""WITH {FEATURES}, c AS (SELECT label, pos, avg(v) AS v FROM e GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(v * v)) AS n FROM c GROUP BY label)
  SELECT a.label AS a, b.label AS b, round(sum(a.v * b.v) / any_value(na.n * nb.n), 6) + 0e0 AS cosine FROM c a JOIN c b ON a.pos = b.pos AND a.label < b.label JOIN n na ON na.label = a.label JOIN n nb ON nb.label = b.label GROUP BY 1, 2""")
def similarity_cosine(spark, sf):
    means = _features(spark, sf).groupBy("label", "pos").agg(F.avg("v").alias("v"))
    vectors = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("z")).select("label", F.transform("z", lambda x: x["v"]).alias("v"))
    return rounded(rollup.cosine_similarity(vectors, "label", "v"))


@query(f"""WITH {FEATURES} SELECT a.pos AS i, b.pos AS j, round(avg(abs(a.v * b.v)), 6) AS strength FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.pos < b.pos GROUP BY 1, 2 ORDER BY avg(abs(a.v * b.v)) DESC, i, j LIMIT 50""")
def interaction_top(spark, sf):
    """A vector's pairs come from its own array, without a join."""
    rows = table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("e"))
    one = rows.select("e", F.posexplode("e").alias("i", "a"))
    both = one.select(F.col("i").cast("long").alias("i"), "a", F.posexplode("e").alias("j", "b")).withColumn("j", F.col("j").cast("long")).where("i < j")
    return rounded(rollup.interactions(both.withColumn("z", F.col("a") * F.col("b")), "i", "j", "z"))


@query(rounded_sql("", "SELECT solvent, flag, avg(abs(y)) AS mean_abs, stddev_pop(abs(y)) AS std, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= 100", "mean_abs std"))
def occlusion_rollup(spark, sf):
    return rounded(rollup.occlusion(measurements(spark, sf), ["solvent", "flag"], "y", 100))


@query(rounded_sql("g AS (SELECT solute, flag, sum(y) AS total FROM m GROUP BY ALL)", "SELECT solute, flag, total, abs(total) / sum(abs(total)) OVER (PARTITION BY solute) AS share, row_number() OVER (PARTITION BY solute ORDER BY abs(total) DESC, flag) = 1 AS dominant FROM g", "total share"))
def group_contributions(spark, sf):
    return rounded(rollup.contributions(measurements(spark, sf), "solute", "flag", "y"))


@query(rounded_sql(FITS, "SELECT count(*) AS n, avg(r2) AS mean FROM fit WHERE r2 >= 8e-1 AND rmse <= 3e-1 AND t_min <= 298.15e0 AND t_max >= 298.15e0", "mean", 4))
def fit_quality_filter(spark, sf):
    return rounded(_fits(spark, sf).withColumn("model", F.lit("apelblat")).where(filters.fit_quality(["apelblat"], 0.8)).agg(F.count(F.lit(1)).alias("n"), F.avg("r2").alias("mean")), 4)


@query()
def scaling_fit(spark, sf):
    e = F.abs(F.col("y") - F.col("x"))
    curve = measurements(spark, sf).groupBy("flag", "seed").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(e).alias("v"))
    return fits.scaling_law(curve, ["flag"], "n", "v")


@query()
def density_curve(spark, sf):
    return rollup.density_curve(measurements(spark, sf, "raw"), "y")


@query()
def correlation_filter(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_quantity") * 2 + F.col("l_tax")).alias("twice"))
    return spark.createDataFrame([(c,) for c in rollup.correlated_features(rows, rows.columns)], "feature string")


@query("SELECT DISTINCT (SELECT count(*) FROM documents WHERE text IN (SELECT text FROM benchmark)) AS n")
def documents_in_benchmark(spark, sf):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark").select("text").distinct()
    return docs.join(bench, "text", "left_semi").agg(F.count(F.lit(1)).alias("n"))


