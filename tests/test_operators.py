"""Small fixtures whose results are known by hand, and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from tarnwick.functions import scalar
from tarnwick.operators import audit, curves, filters, fits, metrics, pairs, profile, rollup, splits, tiers
from tarnwick.operators.graph import components
from tarnwick.sources import readers, schema, sinks

K = ["solute", "solvent"]


def measured(spark, rows):
    return spark.createDataFrame(rows, "solute string, solvent string, source string, t double, y double").withColumn("rid", F.monotonically_increasing_id())


def maes(spark, rows):
    points = pairs.paired(pairs.readings(measured(spark, rows), K, "source", "t", "y", ["rid"]), K, "source", "t", "y")
    return audit.copies(pairs.pair_maes(points, K)).collect()


def test_exact_copy(spark):
    (r,) = maes(spark, [("p", "v", "s1", 298.15, -1.0), ("p", "v", "s1", 303.15, -0.9), ("p", "v", "s2", 298.15, -1.0001), ("p", "v", "s2", 303.15, -0.9002)])
    assert r["kind"] == "exact" and r["mae"] == pytest.approx(0.00015)


def test_near_copy(spark):
    (r,) = maes(spark, [("p", "v", "s1", 298.15, -1.0), ("p", "v", "s1", 303.15, -0.9), ("p", "v", "s2", 298.15, -1.006), ("p", "v", "s2", 303.15, -0.906)])
    assert r["kind"] == "near" and r["mae"] == pytest.approx(0.006)


def test_half_even(spark):
    row = spark.range(1).select(F.bround(F.lit(2.5), 0), F.bround(F.lit(3.5), 0), F.bround(F.lit(-2.5), 0), F.bround(F.lit(0.125), 2)).head()
    assert list(row) == [2, 4, -2, 0.12]


def test_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "x string, y string")
    assert {r["node"]: r["component"] for r in components(edges, "x", "y").collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(60)], "x string, y string")
    assert {r["component"] for r in components(edges, "x", "y").collect()} == {"000"}


def test_apelblat_exact(spark):
    rows = [("p", "v", "s", t, 1 - 500 / t + 0.3 * math.log(t)) for t in (280.0, 290.0, 300.0, 310.0)]
    r = fits.apelblat_fits(measured(spark, rows), K, "t", "y").head()
    assert (r["a"], r["b"], r["c"], r["r2"]) == pytest.approx((1, -500, 0.3, 1), rel=1e-4)


def test_three_points_have_no_covariance(spark):
    rows = [("p", "v", "s", t, t / 100) for t in (280.0, 290.0, 300.0)]
    assert fits.apelblat_fits(measured(spark, rows), K, "t", "y").head()["s2"] is None


def test_vanthoff(spark):
    r = fits.vanthoff_fits(measured(spark, [("p", "v", "s", 290.0, -2.0), ("p", "v", "s", 310.0, -1.5)]), K, "t", "y").head()
    assert r["a"] + r["b"] / 290 == pytest.approx(-2) and r["r2"] == pytest.approx(1)


def test_bounded_fit_respects_bounds(spark):
    rows = [("p", "v", "s", t, y) for t, y in ((280.0, 0.0), (290.0, 9.0), (300.0, -9.0), (310.0, 5.0))]
    r = fits.bounded_fits(measured(spark, rows), K, "t", "y").head()
    assert abs(r["a"]) <= 200.001 and abs(r["b"]) <= 1e5 * 1.001 and abs(r["c"]) <= 50.001


def _curve(t):
    return 1 - 500 / t + 0.3 * math.log(t)


def test_consensus_at_shared_temperatures(spark):
    rows = [("p", "v", "s1", float(t), _curve(t)) for t in (280, 290, 300, 310)] + [("p", "v", "s2", float(t), _curve(t) + 0.1) for t in (300, 310, 320, 330)]
    found = {r["t"]: r for r in tiers.consensus(measured(spark, rows), K, "source", "t", "y").collect()}
    assert sorted(found) == [300, 310] and all(r["n_sources"] == 2 and r["sigma"] == pytest.approx(0.05, abs=1e-6) for r in found.values())


def test_consensus_without_overlap(spark):
    rows = [("p", "v", "s1", float(t), _curve(t)) for t in (280, 283, 286, 290)] + [("p", "v", "s2", float(t), _curve(t)) for t in (310, 313, 316, 320)]
    found = tiers.consensus(measured(spark, rows), K, "source", "t", "y").collect()
    assert len(found) == 8 and all(r["n_sources"] == 1 and r["sigma"] is None for r in found)


def predictions(spark, rows):
    return spark.createDataFrame(rows, "split string, solvent string, y double, pred double, sigma double")


def test_ps_rmse(spark):
    rows = [("e", "x", 1.0, 0.0, None), ("e", "x", 1.0, 0.0, None), ("e", "y", 3.0, 0.0, None), ("e", "y", 3.0, 0.0, None), ("e", "z", 9.0, 0.0, None)]
    one = metrics.metric_suite(predictions(spark, rows), "split", "solvent", "y", "pred", "sigma").head()
    assert one["ps_rmse"] == pytest.approx(2) and one["n_solvents"] == 2 and one["z_rmse"] is None
    two = metrics.metric_suite(predictions(spark, rows + rows[:2]), "split", "solvent", "y", "pred", "sigma").head()
    assert two["ps_rmse"] == pytest.approx(2) and two["rmse"] != pytest.approx(one["rmse"])


def test_z_rmse(spark):
    r = metrics.metric_suite(predictions(spark, [("e", "x", 0.02, 0.0, 0.005), ("e", "x", 0.5, 0.0, None)]), "split", "solvent", "y", "pred", "sigma").head()
    assert r["z_rmse"] == pytest.approx(2) and r["f_aleatoric"] == 0 and r["n_uncertain"] == 1


def test_split_stratified(spark):
    rows = [(s, f"{s}{i}") for s, n in (("a", 1), ("b", 2), ("c", 10)) for i in range(n)]
    out = splits.stratified_validation(spark.createDataFrame(rows, "s string, k string"), "s", ["k"])
    assert {r["s"]: r["n"] for r in out.where("split = 'validation'").groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()} == {"b": 1, "c": 1}


def test_group_holdout(spark):
    rows = [(v, f"{v}{i}") for v, n in (("a", 3), ("b", 3), ("c", 1)) for i in range(10) for _ in range(n)]
    out = splits.group_holdout(spark.createDataFrame(rows, "v string, s string"), "v", "s", top=2).select("v", "s", "split").distinct().collect()
    assert {r["v"] for r in out if r["split"] == "ood"} == {"c"}
    assert sorted(r["v"] for r in out if r["split"] == "eval") == ["a", "b"]
    assert not {(r["v"], r["s"]) for r in out if r["split"] == "eval"} & {(r["v"], r["s"]) for r in out if r["split"] == "train"}


def test_waterfall_sums(spark):
    df = spark.range(10).select(F.when(F.col("id") > 0, F.col("id").cast("double")).alias("x"))
    kept, table = filters.waterfall(df, [filters.Stage("present", filters.present("x")), filters.Stage("low", F.col("x") > 2), filters.Stage("high", F.col("x") < 8)])
    rows = {r["label"]: (r["removed"], r["remaining"]) for r in table.collect()}
    assert rows == {"present": (1, 9), "low": (2, 7), "high": (2, 5)} and kept.count() == 5


def test_nan_is_dropped(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    assert df.where(filters.within("x", -10, 10)).count() == 1 and schema.nan_to_null(df).where("x is null").count() == 2


def test_deny_list_keeps_null(spark):
    assert spark.createDataFrame([(None,), ("a",), ("b",)], "s string").where(filters.not_listed("s", ["a"])).count() == 2


def test_leak_matrix(spark):
    df = spark.createDataFrame([("train", "a", "b"), ("eval", "a", "c"), ("gold", "d", "x")], "split string, solute string, solvent string")
    assert splits.leak_matrix(df, "split", K).count() == 0
    (r,) = splits.leak_matrix(df, "split", ["solute"]).collect()
    assert (r["left"], r["right"], r["n"]) == ("eval", "train", 1)


def test_gradients(spark):
    df = spark.createDataFrame([("p", "v", 0.0, 0.0), ("p", "v", 1.0, 1.0), ("p", "v", 3.0, 9.0)], "solute string, solvent string, t double, y double")
    assert [r["gradient"] for r in metrics.gradients(df, K, "t", "y", -10, 10).orderBy("t").collect()] == pytest.approx([1, 2, 4])


def test_tolerance_join_takes_the_first_match(spark):
    rows = [("p", "v", "a", 300.0, 1.0), ("p", "v", "b", 300.05, 2.0), ("p", "v", "b", 299.95, 3.0), ("p", "v", "b", 300.2, 4.0)]
    (r,) = pairs.tolerance_join(measured(spark, rows).coalesce(1), K, "source", "t", "y", ["rid"]).collect()
    assert (r["t2"], r["y2"]) == (300.05, 2.0)


def test_tiers_are_nested(spark):
    rows = spark.createDataFrame([("a", 0.05), ("b", 0.15), ("c", 0.4), ("d", 0.01), ("e", 0.9)], "solute string, mae double")
    found = {}
    for r in tiers.tier_membership(rows).collect():
        found.setdefault(r["tier"], set()).add(r["solute"])
    assert found == {"gold": {"a"}, "silver": {"a", "b"}, "bronze": {"a", "b", "c"}}


def test_significant_digits(spark):
    df = spark.createDataFrame([(1.0,), (0.00120,), (123.45,), (0.0,), (1e-9,), (None,)], "x double")
    assert [r[0] for r in df.select(scalar.significant_digits(F.col("x"))).collect()] == [1, 2, 5, 0, 1, None]


def test_log_solubility_guards(spark):
    df = spark.createDataFrame([(0.5, 1.0, 100.0), (0.0, 1.0, 100.0), (1.0, 1.0, 100.0), (0.5, None, 100.0), (0.5, 0.0, 100.0)], "x double, d double, w double")
    found = [r[0] for r in df.select(scalar.log_solubility(F.col("x"), F.col("d"), F.col("w"))).collect()]
    assert found[0] == pytest.approx(1.0) and found[1:] == [None] * 4


def test_readers_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    sinks.write_csv(df, f"{tmp_path}/c", ["k"], gzip=True)
    assert readers.read_csv(spark, f"{tmp_path}/c", df.schema, {"k"}).orderBy("k").collect() == df.orderBy("k").collect()
    built = []
    for _ in range(2):
        readers.cached(spark, f"{tmp_path}/p", lambda: built.append(1) or df)
    assert built == [1] and readers.feature_store(spark, f"{tmp_path}/p", "k", ["v"]).count() == 2
    (tmp_path / "m.json").write_text('{"method": "x", "fraction": 1.0, "seed": 3, "metrics": {"eval": {"rmse": 0.5, "mae": 0.25}}}')
    assert {(r["metric"], r["value"]) for r in readers.read_metrics(spark, f"{tmp_path}/m.json").collect()} == {("rmse", 0.5), ("mae", 0.25)}
    with pytest.raises(ValueError, match="missing"):
        schema.require(df, {"z"})
    assert sinks.text_table(df.orderBy("k")).splitlines()[2] == "| a | 1.5 |" and "tabular" in sinks.text_table(df, "latex")


def test_unknown_features_are_an_error(spark):
    store = spark.createDataFrame([("a", 1.0)], "k string, f double")
    with pytest.raises(Exception, match="no features"):
        pairs.feature_lookup(spark.createDataFrame([("z",)], "c string"), store, "k", {"c": "p"}, ["f"]).collect()


def test_running_share_reaches_one(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)] * 3, "k string")
    rows = profile.running_share(df, "k").orderBy("rank").collect()
    assert [(r["k"], r["rank"]) for r in rows] == [("a", 1), ("b", 2), ("c", 3)] and rows[-1]["share"] == pytest.approx(1)


def test_correlated_features(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), (F.col("id") % 7).cast("double").alias("c"), F.lit(1.0).alias("d"))
    assert rollup.correlated_features(df, ["a", "b", "c", "d"]) == ["a", "c"]


def test_curve_consistency_of_itself(spark):
    rows = [("p", "v", "s", float(t), _curve(t)) for t in range(280, 320, 5)]
    r = curves.consistency(measured(spark, rows).withColumn("pred", F.col("y")), K, "t", "y", "pred").head()
    assert r["r2"] == pytest.approx(1) and r["shape"] == pytest.approx(1) and r["slope_ratio"] == pytest.approx(1)


def test_empty_input(spark):
    empty = measured(spark, [])
    assert fits.apelblat_fits(empty, K, "t", "y").count() == 0 and splits.kfold(empty, ["rid"]).count() == 0
    assert metrics.duplicate_floor(empty, K, "t", "y").head()["n_groups"] == 0


def test_average_linkage(spark):
    rows = [("a", "b", 0.9), ("a", "c", 0.1), ("a", "d", 0.0), ("b", "c", 0.2), ("b", "d", 0.1), ("c", "d", 0.8)]
    found = rollup.average_linkage(spark.createDataFrame(rows, "a string, b string, cosine double"), 2)
    assert found["a"] == found["b"] != found["c"] == found["d"]


def test_closed_walks(spark):
    from tarnwick.operators.graph import closed_walks

    rows = [(1, a, b) for a, b in ((1, 2), (2, 3), (3, 1), (2, 1), (3, 3))] + [(2, a, b) for a, b in ((1, 2), (2, 3), (3, 4), (4, 1))] + [(3, 1, 2)]
    found = {r["g"]: (r["n_edges"], r["n_triangles"], r["n_squares"]) for r in closed_walks(spark.createDataFrame(rows, "g int, a int, b int"), "g", "a", "b").collect()}
    assert found == {1: (3, 1, 0), 2: (4, 0, 1), 3: (1, 0, 0)}
