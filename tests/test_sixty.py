"""What the queries on sources' disagreement write and compare: few numbers of a reading, and no pair where a sum or a rank tells."""

import random

import numpy as np
import pytest

from tarnwick.operators import blocks
from tarnwick.plans import registry, views

DIR = "/root/testdata/sf0.01"


def _side(n, error, seed=1):
    rng = random.Random(seed)
    rows = [(str(s), float(t), (None if rng.random() < 0.02 else 0.02 * t + error * rng.random())) for s in range(n) for t in sorted(rng.sample(range(50), 12))]
    names = [str(s) for s in range(n)]
    rank = np.argsort(np.argsort(np.array(names)))
    at = np.array([int(r[0]) for r in rows])
    t = np.array([r[1] for r in rows])
    return blocks.Side(names, rank, np.array([t[at == s].min() for s in range(n)]), np.array([t[at == s].max() for s in range(n)]), np.full(n, 12.0), at, t, np.array([np.nan if r[2] is None else r[2] for r in rows]), np.array([r[2] is None for r in rows]), {})


@pytest.mark.parametrize("error", [0.02, 1.0])
def test_sums_of_sifted_pairs_are_those_of_all(error):
    side, least = _side(600, error), 45.0

    def told(near):
        out, most, spared = np.zeros(6), None, 0
        for t in blocks.tiles(side, side, True, 3, True, near, lambda a, b: ~blocks._apart(a, b, least)):
            keep = t.pair & ~t.copies(0.01) & t.apart(least)
            out += [t.copies(0.01).sum(), keep.sum(), t.known_n[keep].sum(), t.absolute(keep), t.total[keep].sum(), t.squares[keep].sum()]
            most = t.most(keep, most)
            spared += t.cells is not None
        return [*out, most], spared

    every, spared = told(None)
    assert not spared
    sifted, spared = told(0.01)
    assert sifted == pytest.approx(every, abs=1e-6)
    assert spared or error < 1


def test_stratified_limit_writes_few_numbers_of_a_reading(spark):
    """Before, lineitem was shuffled for its parts, and again with names and the text rid."""
    plan = views.by_source(spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    top, below = plan.split("RepartitionByExpression", 1)
    assert "concat_ws" in top and "concat_ws" not in below and "n_name" not in below.split("Join")[0] and plan.count("strategy=broadcast") >= 2
    found = {r["stratum"]: r["n"] for r in registry.QUERIES["stratified_limit"](spark, DIR).collect()}
    assert found["all"] > 0


def test_composite_limit_takes_curves_without_pairs(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tarnwick.operators import audit, fits

    rng = random.Random(2)
    told = spark.createDataFrame([("p", f"v{s % 2}", f"s{s}", float(t), round(rng.random(), 2)) for s in range(9) for t in range(2 + s % 3)], "a string, b string, source string, t double, y double")
    one, two = (told.select("a", "b", "t", F.col("source").alias(f"source{i}"), F.col("y").alias(f"y{i}")) for i in (1, 2))
    want = one.join(two, ["a", "b", "t"]).where("source1 < source2").groupBy("a", "b").agg(*audit.error_summary(F.col("y1") - F.col("y2")))
    got = fits.disagreement(told, ["a", "b"], "source").select(want.columns)
    for g, w in zip(got.orderBy("b").collect(), want.orderBy("b").collect(), strict=True):
        assert tuple(g)[:2] == tuple(w)[:2] and tuple(g)[2:] == pytest.approx(tuple(w)[2:])

    def paired(*_, **__):
        raise AssertionError("curves were joined")

    monkeypatch.setattr(fits, "interpolated", paired)
    assert registry.QUERIES["composite_limit"](spark, DIR).count() == 1


@pytest.mark.parametrize("witnesses", [1, 64])
def test_copies_of_all_others(spark, monkeypatch, witnesses):
    monkeypatch.setattr(blocks, "WITNESSES", witnesses)
    monkeypatch.setattr(blocks, "BLOCK", 2)
    values = {"g": [0.0, 0.006, 0.012, 0.018], "h": [0.0, 0.001, 0.002, 0.003], "i": [0.0, 0.004, 0.008, 0.012]}
    rows = spark.createDataFrame([(k, "v", f"s{i}", [1.0, 2.0], [y, y + 1], 1.0, 2.0, 2) for k, ys in values.items() for i, y in enumerate(ys)], "a string, b string, source string, ts array<double>, ys array<double>, lo double, hi double, n long")
    got = sorted((r["a"], r["source"]) for r in blocks.copies_of_all(rows, ["a", "b"], "source").collect())
    assert got == [*(("h", f"s{i}") for i in range(4)), ("i", "s1"), ("i", "s2")]


@pytest.mark.parametrize("name", ["variability", "tier_membership", "tier_rows"])
def test_fitted_groups_are_not_paired(spark, monkeypatch, name):
    def every(*_, **__):
        raise AssertionError("all copies of fitted sources were counted")

    monkeypatch.setattr(blocks, "copied_among", every)
    assert registry.QUERIES[name](spark, DIR).limit(1).count() == 1
