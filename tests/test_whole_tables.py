"""Queries that must see every nation and every feature, by force."""

import os

import numpy as np
import pytest

from tarnwick.plans import queries_audit, registry

DIR = "/root/testdata/sf0.01"  # the smallest tables have few nations
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def test_tolerance_join_sees_every_nation(spark):
    rows = registry.QUERIES["tolerance_join"](spark, DIR).collect()
    assert {r["solvent"] for r in rows} > {f"NATION_{i}" for i in (0, 1, 2, 9, 10, 14, 24)}
    assert all(abs(r["t1"] - r["t2"]) < 0.1 and r["source1"] < r["source2"] for r in rows)


def test_groups_use_copies_of_every_nation(spark):
    copies = queries_audit._copies(spark, DIR).collect()
    assert any(c["solvent"] >= "NATION_14" for c in copies)
    group = {r["source"]: r["group_id"] for r in registry.QUERIES["independence_groups"](spark, DIR).collect()}
    label = {s: s for s in group}
    while moved := [c for c in copies if label[c["source1"]] != label[c["source2"]]]:
        for c in moved:
            label[c["source1"]] = label[c["source2"]] = min(label[c["source1"]], label[c["source2"]])
    assert group == label


def test_interactions_look_at_every_feature(spark):
    vectors = [r["embedding"] for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    x = np.abs(np.array(vectors, float))
    mean = x.T @ x / len(x)
    best = sorted(((-mean[i, j], i, j) for i in range(64) for j in range(i + 1, 64)))[:50]
    got = [(r["i"], r["j"], r["strength"]) for r in registry.QUERIES["interaction_top"](spark, DIR).collect()]
    assert [g[:2] for g in got] == [b[1:] for b in best] and [g[2] for g in got] == pytest.approx([-b[0] for b in best], abs=1e-6)
    assert any(j >= 12 for _, j, _ in got)


def test_fit_filter_rejects_fits(spark):
    fits = queries_audit._fits(spark, DIR).collect()
    good = [f for f in fits if f["r2"] is not None and f["r2"] >= 0.8 and f["rmse"] <= 0.3 and f["t_min"] <= 298.15 <= f["t_max"]]
    (r,) = registry.QUERIES["fit_quality_filter"](spark, DIR).collect()
    assert 0 < r["n"] == len(good) < len(fits)
