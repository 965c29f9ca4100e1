"""Queries on differences of all pairs take them from values in order: equal to all pairs by force, and no pair is a row."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarnwick.operators import fits, pairs, spreads
from tarnwick.plans import queries_audit, registry

DIR = "/root/testdata/sf0.01"


def _table(spark, n=40, odd=False, step=0.25):
    """Readings with ties of a source's temperatures (the order is a text), equal values, temperatures of one source, and null values."""
    rng = random.Random(3)
    rows = [("p", f"v{i % 2}", i, float(t % 5), None if rng.random() < 0.05 else rng.choice([round(rng.random(), 2), step]), rng.choice([9, 10, 101]), float(k)) for i in range(n) for k, t in enumerate(range(9))]
    rows += [("q", "v", 1, 1.0, 0.5, 1, 1.0)]
    if odd:
        rows += [("p", "v0", 1000 + k, 2.0, y, 1, 1.0) for k, y in enumerate([math.inf, math.inf, -math.inf, math.nan, math.nan, 0.0, -0.0])]
    df = spark.createDataFrame(rows, "a string, b string, source long, t double, y double, o long, x double")
    return df, spreads.values(df, ["a", "b"], "source", "t", "y", ["o", "x"], text=True), pairs.readings(df.withColumn("rid", F.concat_ws("-", "o", "x")), ["a", "b"], "source", "t", "y", ["rid"])


def _absolute(readings):
    by = {}
    for r in readings.where("y is not null").collect():
        by.setdefault((r["a"], r["b"], r["t"]), []).append(r["y"])
    key = lambda d: (math.isnan(d), d)
    return sorted((abs(x - z) for ys in by.values() for i, x in enumerate(ys) for z in ys[:i]), key=key)


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("small", [False, True])
def test_cutoffs_are_those_of_all_pairs(spark, monkeypatch, odd, small):
    if small:  # long lists, and many rounds
        for name, n in {"CHUNK": 7, "FEW": 9, "CELLS": 5, "SAMPLE": 400}.items():
            monkeypatch.setattr(spreads, name, n)
    _, lists, readings = _table(spark, 30, odd)
    every = _absolute(readings)
    got = {r["cutoff"]: tuple(r)[1:] for r in spreads.cutoff_sensitivity(lists, [0.0, 0.25, 0.6, 99.0] if not small else [0.0, 0.25]).collect()}
    want = {}
    for c in [0.0, 0.25, 0.6, 99.0] if not small else [0.0, 0.25]:
        if d := [x for x in every if math.isnan(x) or x >= c]:
            want[c] = len(d), sum(d) / len(d), (d[(len(d) - 1) // 2] + d[len(d) // 2]) / 2
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c], nan_ok=True) for c in want)


def test_no_pairs_no_cutoffs(spark):
    df, lists, _ = _table(spark, 1)
    assert spreads.cutoff_sensitivity(lists, [0.0]).count() == 0


def test_text_order_with_nulls_and_large_numbers(spark):
    rows = [(None, 3.0), (12, 1e7), (12, 123456.0), (12, 1e-4), (1, None), (12, 0.5), (-3, 2.0), (12, None), (123, 1.0)]
    df = spark.createDataFrame([("g", k // 3, 1.0, float(k), *r) for k, r in enumerate(rows)], "a string, source long, t double, y double, o long, x double")
    got = spreads.values(df, ["a"], "source", "t", "y", ["o", "x"], text=True).head()
    want = df.groupBy("source").agg(F.min_by("y", F.concat_ws("-", "o", "x")).alias("y"))
    assert list(got["v"]) == sorted(r["y"] for r in want.collect())


def test_cutoff_sensitivity_shuffles_no_text(spark, monkeypatch):
    """Before, readings were reduced by the text rid, which filled the disk."""

    def readings(*_, **__):
        raise AssertionError("readings were shuffled with their text")

    monkeypatch.setattr(pairs, "readings", readings)
    assert {r["cutoff"] for r in registry.QUERIES["cutoff_sensitivity"](spark, DIR).collect()} == {0.0, 0.01, 0.05, 0.1}


@pytest.mark.parametrize("small", [False, True])
def test_laws_are_those_of_all_pairs(spark, monkeypatch, small):
    if small:
        for name, n in {"CHUNK": 7, "BINS": 512}.items():
            monkeypatch.setattr(spreads, name, n)
    df, lists, readings = _table(spark, 60)
    every = [(d,) for d in _absolute(readings)]
    want = {r["law"]: r for r in fits.distribution_fits(spark.createDataFrame(every, "d double"), "d").collect()}
    got = {r["law"]: r for r in spreads.distribution_fits(lists).collect()}
    assert got.keys() == want.keys() and all(tuple(got[k])[1:] == pytest.approx(tuple(want[k])[1:], abs=1e-9) for k in want)


def test_laws_without_spread_and_of_nothing(spark):
    rows = [("g", k, 1.0, float(k), 1) for k in range(2)]
    df = lambda rows: spreads.values(spark.createDataFrame(rows, "a string, source long, t double, y double, o long"), ["a"], "source", "t", "y", ["o"])
    told = {r["law"]: tuple(r)[1:] for r in spreads.distribution_fits(df(rows)).collect()}
    assert told["lognormal"] == (0.0, 0.0, None) and told["exponential"] == (1.0, 0.0, None) and told["halfnormal"][:2] == (0.0, 1.0)
    assert {tuple(r)[1:] for r in spreads.distribution_fits(df(rows[:1])).collect()} == {(None, None, None)}


def test_distribution_fit_shuffles_no_text(spark, monkeypatch):
    """Before, readings were reduced by the text rid, which filled the disk."""

    def readings(*_, **__):
        raise AssertionError("readings were shuffled with their text")

    old = {r["law"]: tuple(r)[1:] for r in fits.distribution_fits(queries_audit._differences(spark, DIR), "d", "k").collect()}
    monkeypatch.setattr(pairs, "readings", readings)
    got = {r["law"]: tuple(r)[1:] for r in registry.QUERIES["distribution_fit"](spark, DIR).collect()}
    assert all(got[k] == pytest.approx(old[k], abs=1e-9) for k in old)
