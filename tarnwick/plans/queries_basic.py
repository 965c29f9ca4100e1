"""Queries of scans, filters, profiles, splits and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwick.functions import scalar, stats
from tarnwick.operators import filters, pairs, profile, splits
from tarnwick.plans.views import KEYS, RAW, measurements, rounded, rounded_sql
from tarnwick.sources.schema import nan_to_null, standardise
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


RANK = "row_number() OVER (PARTITION BY {by} ORDER BY md5(concat_ws('|', '42', {key})), {key})"


@query(rounded_sql("", "SELECT rid, solute, t, y FROM m WHERE t > 300e0", "t y"))
def scan_projection(spark, sf):
    return rounded(measurements(spark, sf).where("t > 300").select("rid", "solute", "t", "y"))


BAD = ["Brand#11", "Brand#22"]


@query(rounded_sql("", """SELECT cast(stage AS bigint) AS stage, label, count(*) FILTER (fail = stage) AS removed, count(*) FILTER (fail > stage) AS remaining FROM (SELECT CASE WHEN solute IN ('Brand#11', 'Brand#22') THEN 0 WHEN contains(kind, 'BRASS') THEN 1
  WHEN NOT (y BETWEEN -1e0 AND 0.9e0) THEN 2 WHEN sigma IS NULL THEN 3 WHEN weight > 45e0 THEN 4 ELSE 5 END AS fail FROM m),
  (VALUES (0, 'sources'), (1, 'pattern'), (2, 'range'), (3, 'present'), (4, 'weight')) s(stage, label) GROUP BY 1, 2""", view=RAW))
def waterfall_counts(spark, sf):
    stages = [
        filters.Stage("sources", filters.not_listed("solute", BAD)), filters.Stage("pattern", filters.not_matching("kind", "BRASS")), filters.Stage("range", filters.within("y", -1.0, 0.9)),
        filters.Stage("present", filters.present("sigma")), filters.Stage("weight", F.col("weight") <= 45),
    ]
    return filters.waterfall(measurements(spark, sf, "raw"), stages)[1].select("stage", "label", "removed", "remaining")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING') OR c_mktsegment IS NULL")
def deny_list_filter(spark, sf):
    return table(spark, sf, "customer").where(filters.not_listed("c_mktsegment", ["BUILDING"])).select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_name FROM part WHERE NOT coalesce(regexp_matches(p_name, '[xz]'), false)")
def regex_filter(spark, sf):
    return table(spark, sf, "part").where(filters.not_matching("p_name", "[xz]")).select("p_partkey", "p_name")


@query(rounded_sql("", "SELECT rid, y FROM m WHERE y BETWEEN -1.5e0 AND 2e-1 AND weight <= 40e0", "y"))
def range_filter(spark, sf):
    return rounded(measurements(spark, sf).where(filters.within("y", -1.5, 0.2) & (F.col("weight") <= 40)).select("rid", "y"))


@query("SELECT l_orderkey, l_linenumber, nullif(l_discount, 0e0) AS d, l_tax FROM lineitem WHERE nullif(l_discount, 0e0) IS NOT NULL")
def not_null_subset(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") == 0, float("nan")).otherwise(F.col("l_discount")).alias("d"), "l_tax")
    return nan_to_null(rows).where(filters.present("d", "l_tax"))


@query(rounded_sql("", "SELECT rid, 298.15e0 AS t, y FROM m WHERE t BETWEEN 295.15e0 AND 301.15e0", "t y"))
def pinned_temperature(spark, sf):
    return rounded(filters.pinned_temperature(measurements(spark, sf), "t", 295.15, 301.15, 298.15).select("rid", "t", "y"))


@query("SELECT fragment, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS fragment FROM part) GROUP BY 1 ORDER BY n DESC, fragment LIMIT 30")
def fragment_counts(spark, sf):
    return filters.fragments(table(spark, sf, "part"), "p_type", " ")


@query(rounded_sql("", """SELECT cast(bucket AS bigint) AS bucket, lo, hi, count(y) AS n, 100e0 * count(y) / (SELECT count(*) FROM m) AS percent FROM (VALUES (0, -2e0, -1e0), (1, -1e0, 0e0), (2, 0e0, 5e-1), (3, 5e-1, 3e0)) b(bucket, lo, hi)
  LEFT JOIN m ON y >= lo AND y < hi GROUP BY 1, 2, 3""", "lo hi percent", view=RAW))
def bucket_counts(spark, sf):
    return rounded(filters.bucket_counts(measurements(spark, sf, "raw"), "y", [-2, -1, 0, 0.5, 3]))


@query(rounded_sql("", "SELECT count(*) FILTER (x > 1) AS above_one, count(*) FILTER (x = 1) AS one, count(*) FILTER (x > 99e-2 AND x < 1) AS nearly_one, count(*) FILTER (x = 0) AS zero, count(*) FILTER (x < 0) AS negative, count(*) FILTER (x > 0 AND x < 1e-2) AS tiny FROM m"))
def domain_sanity(spark, sf):
    return filters.domain_counts(measurements(spark, sf), "x", 1e-2)


@query("SELECT o_orderkey AS id, o_totalprice AS price, o_orderstatus FROM orders")
def rename_resolve(spark, sf):
    return standardise(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), {"id": ["orderkey", "o_orderkey"], "price": ["o_totalprice", "total"]})


DENSITY = [("NATION_1", 300.15, 0.91), ("NATION_2", 290.15, 0.85)]
LINES = [("nation_2", -0.001, 1.2), ("nation_3", -0.002, 1.5), ("nation_4", -0.0015, 1.3)]
ALIASES = [("NATION_5", "Nation_4"), ("NATION_6", "nation_3")]


@query(rounded_sql(
    "e(name, t, density) AS (VALUES ('NATION_1', 300.15e0, 91e-2), ('NATION_2', 290.15e0, 85e-2)), l(name, a, b) AS (VALUES ('nation_2', -1e-3, 1.2e0), ('nation_3', -2e-3, 1.5e0), ('nation_4', -1.5e-3, 1.3e0)), al(alias, name) AS (VALUES ('nation_5', 'nation_4'), ('nation_6', 'nation_3'))",
    """SELECT rid, density, CASE WHEN x > 0 AND x < 1 AND density > 0 AND weight > 0 THEN log10(x / (1 - x) * density * 1000 / weight) END AS log_s FROM (SELECT m.rid, m.x, m.weight, coalesce(e.density, l.a * m.t + l.b, l2.a * m.t + l2.b) AS density FROM m
    LEFT JOIN e ON lower(e.name) = lower(trim(m.solvent)) AND e.t = m.t LEFT JOIN l ON l.name = lower(trim(m.solvent)) LEFT JOIN al ON al.alias = lower(trim(m.solvent)) LEFT JOIN l l2 ON l2.name = al.name)""", "density log_s"))
def dimension_fallback_join(spark, sf):
    frame = spark.createDataFrame
    out = pairs.dimension_lookup(measurements(spark, sf), frame(DENSITY, "name string, t double, density double"), frame(LINES, "name string, a double, b double"), "solvent", "t", frame(ALIASES, "alias string, name string"))
    return rounded(out.select("rid", "density", scalar.log_solubility(F.col("x"), F.col("density"), F.col("weight")).alias("log_s")))


@query(rounded_sql("", "SELECT rid, median(y) OVER w AS group_median, count(y) OVER w AS group_n, stddev_samp(y) OVER w AS group_std FROM m WINDOW w AS (PARTITION BY solute, solvent)", "group_median group_std"))
def left_join_group_stats(spark, sf):
    return rounded(profile.with_group_stats(measurements(spark, sf), KEYS, "y").select("rid", "group_median", "group_n", "group_std"))


SUMMARY = "count(y) AS n, avg(y) AS mean, median(y) AS median, stddev_samp(y) AS std, stddev_pop(y) AS std_pop, min(y) AS min, max(y) AS max, max(y) - min(y) AS range"


@query(rounded_sql("", f"SELECT solute, {SUMMARY}, count(DISTINCT source) AS n_sources FROM m GROUP BY solute", "mean median std std_pop min max range"))
def group_summary(spark, sf):
    return rounded(measurements(spark, sf).groupBy("solute").agg(*stats.summary("y"), F.count_distinct("source").alias("n_sources")))


@query(rounded_sql("", "SELECT solvent, quantile_cont(y, 5e-2) AS p5, quantile_cont(y, 5e-1) AS p50, quantile_cont(y, 95e-2) AS p95 FROM m GROUP BY solvent", "p5 p50 p95"))
def percentiles(spark, sf):
    return rounded(stats.percentiles(measurements(spark, sf), "y", [0.05, 0.5, 0.95], ["solvent"]))


@query(rounded_sql("", "SELECT solvent, skewness(y) AS skew, kurtosis(y) AS kurt FROM m GROUP BY solvent", "skew kurt", 5))
def skew_kurtosis(spark, sf):
    return rounded(measurements(spark, sf).groupBy("solvent").agg(stats.skew_corrected("y").alias("skew"), stats.kurtosis_corrected("y").alias("kurt")), 5)


@query(rounded_sql("", "SELECT solute, solvent, stddev_samp(y) AS s1, stddev_pop(y) AS s0 FROM m GROUP BY ALL", "s1 s0"))
def dispersion_both(spark, sf):
    return rounded(measurements(spark, sf).groupBy(*KEYS).agg(F.stddev_samp("y").alias("s1"), F.stddev_pop("y").alias("s0")))


@query(rounded_sql("", "SELECT count(*) AS n_groups, count(*) FILTER (n >= 1) AS ge_1, count(*) FILTER (n >= 2) AS ge_2, count(*) FILTER (n >= 3) AS ge_3, count(*) FILTER (n >= 5) AS ge_5, count(*) FILTER (n >= 10) AS ge_10 FROM (SELECT count(DISTINCT source) AS n FROM m GROUP BY solute, solvent)"))
def nunique_thresholds(spark, sf):
    return profile.at_least_sources(measurements(spark, sf), KEYS, "source", [1, 2, 3, 5, 10])


@query(rounded_sql("", "SELECT * FROM (SELECT solute, solvent, round_even(t, 0) AS tr, avg(y) AS mean, coalesce(stddev_samp(y), 0e0) AS std, count(*) AS n FROM m GROUP BY ALL) WHERE std < 35e-2", "tr mean std", view=RAW))
def group_std_gate(spark, sf):
    rows = measurements(spark, sf, "raw").withColumn("tr", F.bround("t", 0))
    return rounded(profile.steady_groups(rows, [*KEYS, "tr"], "y", 0.35))


@query(rounded_sql("s AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS r FROM m GROUP BY source)", "SELECT cast(top AS bigint) AS top, cast(sum(n) AS bigint) AS rows, sum(n) / (SELECT sum(n) FROM s) AS share FROM s, (VALUES (5), (10), (20), (50)) k(top) WHERE r <= top GROUP BY top", "share"))
def coverage_top_n(spark, sf):
    return rounded(profile.coverage(measurements(spark, sf), "source", [5, 10, 20, 50]))


SHARES = "s AS (SELECT source, count(*) AS n FROM m GROUP BY source), r AS (SELECT source, n, row_number() OVER w AS rank, sum(n) OVER w / (SELECT sum(n) FROM s) AS share FROM s WINDOW w AS (ORDER BY n DESC, source ROWS UNBOUNDED PRECEDING))"


@query(rounded_sql(SHARES, "SELECT * FROM r", "share"))
def running_share(spark, sf):
    return rounded(profile.running_share(measurements(spark, sf), "source"))


@query(rounded_sql(SHARES, "SELECT min(rank) FILTER (share >= 5e-1) AS at_50, min(rank) FILTER (share >= 8e-1) AS at_80, min(rank) FILTER (share >= 95e-2) AS at_95 FROM r"))
def share_ranks(spark, sf):
    return profile.share_reached(profile.running_share(measurements(spark, sf), "source"), [0.5, 0.8, 0.95])


@query("""WITH j AS (SELECT o_orderpriority, o_orderstatus FROM orders) SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM j GROUP BY 1""")
def crosstab_pivot(spark, sf):
    return profile.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", 10, 3)


@query("SELECT p_brand, count(DISTINCT p_type) AS n_p_type, count(DISTINCT p_size) AS n_p_size FROM part WHERE p_brand IS NOT NULL GROUP BY 1 HAVING count(DISTINCT p_type) > 1 OR count(DISTINCT p_size) > 1")
def identifier_consistency(spark, sf):
    return profile.inconsistent(table(spark, sf, "part"), "p_brand", ["p_type", "p_size"])


@query("SELECT n_raw, count(*) AS n FROM (SELECT p_brand, count(DISTINCT p_name) AS n_raw FROM part WHERE p_brand IS NOT NULL GROUP BY 1) GROUP BY 1")
def merge_sizes(spark, sf):
    return profile.merge_sizes(table(spark, sf, "part"), "p_brand", "p_name")


@query(rounded_sql("", "SELECT source, count(*) FILTER (y > 5e-1) AS failed, count(*) AS n, count(*) FILTER (y > 5e-1) / count(*) AS share FROM m GROUP BY source ORDER BY share DESC, failed DESC, source LIMIT 20", "share", view=RAW))
def failure_share(spark, sf):
    return rounded(profile.failure_share(measurements(spark, sf, "raw"), "source", F.col("y") > 0.5))


@query(rounded_sql("", "SELECT source, min(t) AS t_min, max(t) AS t_max, median(t) AS t_median, count(DISTINCT t) AS n_t, max(t) - min(t) AS t_range, CASE WHEN max(t) = min(t) THEN 'isothermal' WHEN max(t) - min(t) <= 10 THEN 'narrow' WHEN max(t) - min(t) <= 50 THEN 'medium' ELSE 'wide' END AS kind FROM m GROUP BY source", "t_min t_max t_median t_range"))
def temperature_coverage(spark, sf):
    return rounded(profile.temperature_coverage(measurements(spark, sf), "source", "t"))


@query(rounded_sql("", "SELECT value, count(*) FILTER (t = value) AS exact, count(t) AS close FROM (VALUES (298.15e0), (303.15e0), (400e0)) v(value) LEFT JOIN m ON abs(t - value) <= 5e-1 GROUP BY value", "value"))
def value_clusters(spark, sf):
    return rounded(profile.value_clusters(measurements(spark, sf), "t", [298.15, 303.15, 400.0]))


@query(rounded_sql("g AS (SELECT solute, solvent, count(*) AS n, stddev_samp(y) AS std FROM m GROUP BY ALL)", "SELECT CASE WHEN n < 95 THEN 'rare' ELSE 'common' END AS kind, count(*) AS groups, avg(std) AS mean_std, median(std) AS median_std FROM g GROUP BY 1", "mean_std median_std"))
def rare_vs_common(spark, sf):
    rows = measurements(spark, sf).withColumn("k", scalar.key_of("|", "solute", "solvent"))
    return rounded(profile.rare_and_common(rows, "k", "y", 95))


@query(rounded_sql("", "SELECT * FROM (SELECT cast(CASE WHEN t < 280 THEN 0 WHEN t < 300 THEN 1 WHEN t < 325 THEN 2 END AS bigint) AS bin, count(y) AS n, avg(y) AS mean, median(y) AS median FROM m WHERE t >= 270 GROUP BY 1) WHERE n >= 5 AND bin IS NOT NULL", "mean median"))
def strata_bins(spark, sf):
    return rounded(profile.strata(measurements(spark, sf), "t", "y", [270.0, 280.0, 300.0, 325.0]))


@query(rounded_sql("", "SELECT cast(floor((y - -2e0) / 25e-2) AS bigint) AS bin, count(*) AS n FROM m GROUP BY 1", view=RAW))
def histogram_edges(spark, sf):
    return profile.uniform_histogram(measurements(spark, sf, "raw"), "y", -2.0, 0.25)


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def topk_value(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)


@query("SELECT p_brand, p_partkey, p_retailprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3")
def topk_per_group(spark, sf):
    rank = F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return table(spark, sf, "part").withColumn("rank", rank.cast("long")).where("rank <= 3").select("p_brand", "p_partkey", "p_retailprice", "rank")


@query("SELECT c_nationkey AS k, 'customer' AS src FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def union_all(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("src")).unionByName(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("src")))


def _halves(spark, sf):
    rows = measurements(spark, sf)
    return rows.where("t < 290").select("solute", "solvent").distinct(), rows.where("y > -1.2").select("solute", "solvent").distinct()


HALVES = "a AS (SELECT DISTINCT solute, solvent FROM m WHERE t < 290e0), b AS (SELECT DISTINCT solute, solvent FROM m WHERE y > -1.2e0)"


@query(rounded_sql(HALVES, "SELECT * FROM a UNION SELECT * FROM b"))
def union_distinct(spark, sf):
    a, b = _halves(spark, sf)
    return a.union(b).distinct()


@query(rounded_sql(HALVES, "SELECT * FROM a INTERSECT SELECT * FROM b"))
def intersect_pairs(spark, sf):
    a, b = _halves(spark, sf)
    return a.intersect(b)


@query(rounded_sql(HALVES, "SELECT * FROM a EXCEPT SELECT solute, solvent FROM m WHERE y > -8e-1"))
def except_pairs(spark, sf):
    a, _ = _halves(spark, sf)
    return a.subtract(measurements(spark, sf).where("y > -0.8").select(*KEYS))


@query(rounded_sql(HALVES, "SELECT (SELECT count(*) FROM a) AS n_keys, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS n_missing, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) = 0 AS is_subset"))
def subset_check(spark, sf):
    a, b = _halves(spark, sf)
    return splits.contained(a, b, KEYS)


@query(rounded_sql("", "SELECT rid, solvent, CASE WHEN r <= CASE WHEN n <= 1 THEN 0 ELSE least(greatest(1, cast(floor(n * 15e-2) AS bigint)), n - 1) END THEN 'validation' ELSE 'train' END AS split FROM (SELECT rid, solvent, " + RANK.format(by="solvent", key="rid") + " AS r, count(*) OVER (PARTITION BY solvent) AS n FROM m)"))
def split_stratified(spark, sf):
    return splits.stratified_validation(measurements(spark, sf), "solvent", ["rid"]).select("rid", "solvent", "split")


HOLDOUT = """best AS (SELECT solvent, count(*) AS n FROM m GROUP BY solvent ORDER BY n DESC, solvent LIMIT 8),
  ranked AS (SELECT solvent, solute, row_number() OVER (PARTITION BY solvent ORDER BY md5(concat_ws('|', '42', solvent, solute)), solute) AS r, count(*) OVER (PARTITION BY solvent) AS n FROM (SELECT DISTINCT solvent, solute FROM m WHERE solvent IN (SELECT solvent FROM best))),
  s AS (SELECT m.*, CASE WHEN r IS NULL THEN 'ood' WHEN r <= greatest(1, cast(floor(ranked.n * 1e-1) AS bigint)) THEN 'eval' ELSE 'train' END AS split FROM m LEFT JOIN ranked USING (solvent, solute))"""


def _split(spark, sf):
    return splits.group_holdout(measurements(spark, sf), "solvent", "solute", top=8)


@query(rounded_sql(HOLDOUT, "SELECT rid, split FROM s"))
def split_group_holdout(spark, sf):
    return _split(spark, sf).select("rid", "split")


@query(rounded_sql("", "SELECT rid, CASE WHEN r <= ceil(n * 2e-1) THEN 'test' ELSE 'train' END AS split FROM (SELECT rid, row_number() OVER (ORDER BY md5(concat_ws('|', '42', rid)), rid) AS r, count(*) OVER () AS n FROM m)"))
def random_holdout(spark, sf):
    return splits.holdout(measurements(spark, sf).select("rid"), ["rid"], 0.2)


@query(rounded_sql("", "SELECT rid, (row_number() OVER (ORDER BY md5(concat_ws('|', '42', rid)), rid) - 1) % 5 AS fold FROM m"))
def kfold(spark, sf):
    return splits.kfold(measurements(spark, sf).select("rid"), ["rid"])


@query(rounded_sql("", "SELECT rid FROM (SELECT rid, row_number() OVER (ORDER BY md5(concat_ws('|', '42', rid)), rid) AS r, count(*) OVER () AS n FROM m) WHERE r <= greatest(32, round_even(n * 5e-2, 0))"))
def subsample_fraction(spark, sf):
    return splits.subsample(measurements(spark, sf).select("rid"), ["rid"], 0.05)


@query(rounded_sql("", "SELECT rid FROM (SELECT rid, " + RANK.format(by="solvent", key="rid") + " AS r, count(*) OVER (PARTITION BY solvent) AS n FROM m) WHERE r <= greatest(1, round_even(n * 1e-1, 0))"))
def subsample_stratified(spark, sf):
    return splits.stratified_subsample(measurements(spark, sf), "solvent", ["rid"], 0.1).select("rid")


@query(rounded_sql("b AS (SELECT rid, least(floor((y - (SELECT min(y) FROM m)) / (((SELECT max(y) FROM m) - (SELECT min(y) FROM m)) / 50)), 49) AS bin FROM m), r AS (SELECT rid, row_number() OVER (PARTITION BY bin ORDER BY md5(concat_ws('|', '42', rid)), rid) AS r FROM b)",
    "SELECT rid FROM (SELECT rid, row_number() OVER (ORDER BY CASE WHEN r <= 6 THEN 0 ELSE 1 END, md5(concat_ws('|', '42', rid)), rid) AS k FROM r) WHERE k <= 300", view=RAW))
def subsample_binned(spark, sf):
    return splits.binned_subsample(measurements(spark, sf, "raw").select("rid", "y"), "y", ["rid"], 300).select("rid")


@query(rounded_sql("", "SELECT solute, solvent, rid FROM (SELECT *, row_number() OVER (PARTITION BY solute, solvent ORDER BY rid) AS r FROM m) WHERE r = 1 ORDER BY rid LIMIT 40"))
def first_distinct_pairs(spark, sf):
    return splits.first_distinct(measurements(spark, sf).select("solute", "solvent", "rid"), KEYS, ["rid"], 40)


@query(rounded_sql(HOLDOUT + ", d AS (SELECT DISTINCT split, solute FROM s)", 'SELECT a.split AS "left", b.split AS "right", count(*) AS n FROM d a JOIN d b ON a.solute = b.solute AND a.split < b.split GROUP BY 1, 2'))
def leak_matrix(spark, sf):
    return splits.leak_matrix(_split(spark, sf), "split", ["solute"])


VALIDATION = "s AS (SELECT solute, solvent, CASE WHEN r <= CASE WHEN n <= 1 THEN 0 ELSE least(greatest(1, cast(floor(n * 15e-2) AS bigint)), n - 1) END THEN 'validation' ELSE 'train' END AS split FROM (SELECT *, " + RANK.format(by="solvent", key="rid") + " AS r, count(*) OVER (PARTITION BY solvent) AS n FROM m))"


@query(rounded_sql(VALIDATION + ", d AS (SELECT DISTINCT split, solute, solvent FROM s)", 'SELECT a.split AS "left", b.split AS "right", count(*) AS n FROM d a JOIN d b ON a.solute = b.solute AND a.solvent = b.solvent AND a.split < b.split GROUP BY 1, 2'))
def leak_matrix_pairs(spark, sf):
    """The pairs that a split by rows leaks; a split by groups leaks none."""
    return splits.leak_matrix(splits.stratified_validation(measurements(spark, sf), "solvent", ["rid"]), "split", KEYS)


@query(rounded_sql("h AS (SELECT DISTINCT solute, solvent FROM m WHERE y > -5e-1), c AS (SELECT solute, solvent, count(*) AS n FROM m GROUP BY ALL)", "SELECT cast(sum(n) AS bigint) AS n_rows, count(*) AS n_pairs, cast(coalesce(sum(n) FILTER (h.solute IS NOT NULL), 0) AS bigint) AS hit_rows, count(h.solute) AS hit_pairs FROM c LEFT JOIN h USING (solute, solvent)"))
def leakage_report(spark, sf):
    rows = measurements(spark, sf)
    return splits.leak_report(rows, rows.where("y > -0.5"), KEYS)


@query(rounded_sql("p AS (SELECT DISTINCT solute, solvent, 0 AS p FROM m WHERE y > -4e-1 UNION ALL SELECT DISTINCT solute, solvent, 1 FROM m WHERE t > 322e0 AND y > -9e-1 UNION ALL SELECT DISTINCT solute, solvent, 2 FROM m WHERE t < 276e0), b AS (SELECT solute, solvent, min(p) AS p FROM p GROUP BY ALL)",
    "SELECT rid, CASE p WHEN 0 THEN 'gold' WHEN 1 THEN 'ood' WHEN 2 THEN 'eval' ELSE 'train' END AS split FROM m LEFT JOIN b USING (solute, solvent)"))
def priority_split_assignment(spark, sf):
    rows = measurements(spark, sf)
    held = {"gold": rows.where("y > -0.4"), "ood": rows.where("t > 322 and y > -0.9"), "eval": rows.where("t < 276")}
    return splits.priority_split(rows, KEYS, held).select("rid", "split")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return splits.without(table(spark, sf, "customer").select("c_custkey"), urgent.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query(rounded_sql("h AS (SELECT DISTINCT solute, solvent FROM m WHERE y > -5e-1)", "SELECT rid FROM m WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.solute = m.solute AND h.solvent = m.solvent)"))
def anti_join_pairs(spark, sf):
    rows = measurements(spark, sf)
    return splits.without(rows, rows.where("y > -0.5"), KEYS).select("rid")


@query(rounded_sql("", "SELECT rid, group_median, deviation FROM (SELECT rid, median(y) OVER w AS group_median, abs(y - median(y) OVER w) AS deviation, count(y) OVER w AS n FROM m WINDOW w AS (PARTITION BY solute, solvent)) WHERE n >= 3 ORDER BY deviation DESC, rid LIMIT 50", "group_median deviation", view=RAW))
def outlier_ranking(spark, sf):
    return rounded(profile.outliers(measurements(spark, sf, "raw"), KEYS, "y", ties=["rid"]).select("rid", "group_median", "deviation"))


@query("""WITH s AS (SELECT o_custkey, count(*) AS n, coalesce(stddev_samp(v), 0e0) AS std, avg(CASE WHEN v = 0 THEN 0 ELSE length(rtrim(replace(split_part(printf('%.9e', abs(v)), 'e', 1), '.', ''), '0')) END) AS digits,
  avg(CASE WHEN v = 0 OR abs(round_even(v * pow(10e0, 1 - floor(log10(abs(nullif(v, 0))))), 0) / pow(10e0, 1 - floor(log10(abs(nullif(v, 0))))) - v) <= 1e-12 * abs(v) THEN 1e0 ELSE 0e0 END) AS round_share
  FROM (SELECT o_custkey, round(o_totalprice / 1e5, CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 4 END) AS v FROM orders) GROUP BY 1),
  f AS (SELECT *, digits <= 2 AND n >= 10 AS few_digits, (std < 1e-1 AND n >= 20) OR (std < 3e-1 AND n >= 50) AS flat, round_share > 9e-1 AS "round" FROM s)
  SELECT o_custkey, n, round(digits, 6) AS digits, round(std, 6) AS std, round(round_share, 6) AS round_share, few_digits, flat, "round" FROM f WHERE few_digits OR flat OR "round" """)
def suspicion_flags(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", F.when(F.col("o_custkey") % 3 == 0, F.round(F.col("o_totalprice") / 1e5, 1)).otherwise(F.round(F.col("o_totalprice") / 1e5, 4)).alias("v"))
    return rounded(profile.suspicion(rows, "o_custkey", "v"))


@query(rounded_sql("", "SELECT rid, y - (-2e0 + 2e-2 * (t - 273.15e0)) AS residual FROM m ORDER BY abs(y - (-2e0 + 2e-2 * (t - 273.15e0))) DESC, rid LIMIT 20", "residual"))
def consistency_residuals(spark, sf):
    return rounded(profile.residuals(measurements(spark, sf), "y", -2.0 + 0.02 * (F.col("t") - 273.15), ties=["rid"]).select("rid", "residual"))


FEATURES = "e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS pos, label FROM embeddings)"


def _features(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "v")).select("vec_id", "label", F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("v"))


@query(f"WITH {FEATURES} SELECT pos, round(avg(v), 6) + 0e0 AS mean, round(stddev_pop(v), 6) + 0e0 AS std, round(min(v), 6) + 0e0 AS min, round(max(v), 6) + 0e0 AS max, round(avg(v) - 2 * stddev_pop(v), 6) + 0e0 AS low, round(avg(v) + 2 * stddev_pop(v), 6) + 0e0 AS high FROM e GROUP BY pos")
def feature_thresholds(spark, sf):
    return rounded(profile.feature_thresholds(_features(spark, sf), "pos", "v"))


@query(f"WITH {FEATURES}, s AS (SELECT pos, avg(v) AS mean, stddev_pop(v) AS std FROM e GROUP BY pos) SELECT vec_id, pos, round((v - mean) / std, 6) + 0e0 AS z FROM e JOIN s USING (pos) WHERE v < mean - 2 * std OR v > mean + 2 * std")
def unusual_features(spark, sf):
    long = _features(spark, sf)
    return rounded(profile.unusual(long, profile.feature_thresholds(long, "pos", "v"), "pos", "v").select("vec_id", "pos", "z"))


@query(rounded_sql("c AS (SELECT 'p90' AS strategy, quantile_cont(y, 9e-1) AS threshold FROM m UNION ALL SELECT 'p95', quantile_cont(y, 95e-2) FROM m UNION ALL SELECT 'target', min(y) FROM (SELECT y FROM m ORDER BY y DESC LIMIT 500))", "SELECT strategy, threshold, count(*) AS n FROM c JOIN m ON y >= threshold GROUP BY 1, 2", "threshold", view=RAW))
def threshold_choices(spark, sf):
    return rounded(profile.threshold_choices(measurements(spark, sf, "raw"), "y", [0.9, 0.95], 500))


@query(rounded_sql("r AS (SELECT solvent, rank() OVER (PARTITION BY solvent ORDER BY t) + (count(*) OVER (PARTITION BY solvent, t) - 1) / 2e0 AS a, rank() OVER (PARTITION BY solvent ORDER BY y) + (count(*) OVER (PARTITION BY solvent, y) - 1) / 2e0 AS b, t, y FROM m)",
    "SELECT solvent, corr(a, b) AS spearman, corr(t, y) AS pearson, count(*) AS n FROM r GROUP BY solvent", "spearman pearson"))
def rank_correlation(spark, sf):
    return rounded(profile.spearman(measurements(spark, sf), "t", "y", ["solvent"]))


@query(rounded_sql("r AS (SELECT solvent = 'NATION_1' AS f, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2e0 AS r FROM m)", "SELECT count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, coalesce(sum(r) FILTER (f), 0) - count(*) FILTER (f) * (count(*) FILTER (f) + 1) / 2e0 AS u FROM r", "u"))
def mann_whitney(spark, sf):
    return rounded(profile.mann_whitney(measurements(spark, sf), "solvent", "NATION_1", "y").withColumn("u", F.coalesce("u", F.lit(0.0))))


@query(rounded_sql("", "SELECT rid, t / 300 AS t_ratio, 1000 / t AS t_inverse, (t / 300) * (t / 300) AS t_square, ln(t / 300) AS t_log FROM m", "t_ratio t_inverse t_square t_log"))
def temperature_features(spark, sf):
    return rounded(measurements(spark, sf).select("rid", *scalar.temperature_features(F.col("t"))))


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS bigint) AS k, try_cast(event_type AS double) AS none FROM events""")
def json_extract(spark, sf):
    found = F.get_json_object(scalar.json_object(F.concat(F.lit("text "), F.col("props"))), "$.k")
    return table(spark, sf, "events").select("event_id", found.try_cast("long").alias("k"), scalar.number(F.col("event_type")).alias("none"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS states FROM orders GROUP BY 1")
def joined_sets(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(scalar.joined_set(F.col("o_orderstatus")).alias("states"))


@query(f"WITH {FEATURES}, s AS (SELECT vec_id, pos // 32 AS b, avg(v) AS a, sqrt(sum(v * v)) AS n FROM e GROUP BY 1, 2) SELECT vec_id, cast(b AS bigint) AS block, round(sign(a) * n * 1000 / 298.15e0, 4) + 0e0 AS v FROM s")
def block_interactions(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    rows = rows.select("vec_id", F.posexplode(scalar.block_interaction(F.col("e"), 32, F.lit(298.15))).alias("block", "v"))
    return rounded(rows.withColumn("block", F.col("block").cast("long")), 4)


@query("SELECT l_orderkey, l_linenumber, p.p_size AS part_p_size, p.p_retailprice AS part_p_retailprice FROM lineitem LEFT JOIN part p ON l_partkey = p_partkey")
def feature_lookup(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("k"))
    out = pairs.feature_lookup(rows, table(spark, sf, "part"), "p_partkey", {"k": "part"}, ["p_size", "p_retailprice"])
    return out.select("l_orderkey", "l_linenumber", "part_p_size", "part_p_retailprice")


@query("SELECT p_partkey, CASE WHEN starts_with(p_type, 'LARGE') THEN 'L' WHEN starts_with(p_type, 'SMALL') THEN 'S' ELSE 'other' END AS cls FROM part")
def prefix_classes(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scalar.prefix_class(F.col("p_type"), {"LARGE": "L", "SMALL": "S"}, "other").alias("cls"))
