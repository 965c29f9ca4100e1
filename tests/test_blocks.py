"""Queries on pairs of sources take them block by block: with blocks of a few sources they give what one block gives, and no pair of readings is a row."""

import os

import pytest

from tarnwick.operators import blocks, pairs
from tarnwick.plans import registry
from test_oracles import _plain

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
QUERIES = "excluded_pairs pairwise_shared_mae range_gate copycat_near copycat_exact independence_groups source_reliability hall_of_fame variability_direct stratified_limit composite_limit consensus_labels variability tier_membership tier_rows".split()


@pytest.mark.parametrize("name", QUERIES)
def test_blocks_and_no_points(spark, monkeypatch, name):
    def points(*_):
        raise AssertionError("readings were joined")

    monkeypatch.setattr(pairs, "paired", points)
    whole = registry.QUERIES[name](spark, DIR)
    columns = sorted(whole.columns)
    want = _plain(whole.select(columns).collect())
    monkeypatch.setattr(blocks, "BLOCK", 2)
    got = _plain(registry.QUERIES[name](spark, DIR).select(columns).collect())
    assert got == want


def test_counted_differences_are_those_of_points(spark):
    from pyspark.sql import functions as F

    from tarnwick.operators import audit, fits

    rows = [("p", "v", f"s{i}", float(t), 0.01 * ((7 * i + t) % 5)) for i in range(9) for t in range(3)]
    df = spark.createDataFrame(rows, "a string, b string, source string, t double, y double")
    points = pairs.paired(df, ["a", "b"], "source", "t", "y")
    sizes = pairs.differences(df, ["a", "b"], "source", "t", "y")
    assert sizes.agg(F.sum("k")).head()[0] == points.count() > sizes.count()
    by = lambda d: [tuple(r) for r in d.orderBy("cutoff").collect()]
    got, want = by(audit.counted_cutoffs(sizes, [0.0, 0.015, 0.035, 9.0])), by(audit.cutoff_sensitivity(points, [0.0, 0.015, 0.035, 9.0]))
    assert len(got) == 3 and all(g == pytest.approx(w) for g, w in zip(got, want, strict=True))
    law = lambda d: {r["law"]: (r["location"], r["scale"], r["ks"]) for r in d.collect()}
    one = law(fits.distribution_fits(sizes, "d", "k"))
    two = law(fits.distribution_fits(points.select(F.abs(F.col("y1") - F.col("y2")).alias("d")), "d"))
    assert all(one[k] == pytest.approx(two[k]) for k in two)
