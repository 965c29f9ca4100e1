"""Sources' rows are gathered by arrays in one pass, and labels and near readings are taken of them."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwick.operators import blocks, fits
from tarnwick.plans import queries_audit, registry

DIR = "/root/testdata/sf0.01"
K = ["a", "b"]


def _told(spark, digits):
    rng = random.Random(3)
    rows = [("p", f"v{s % 2}", f"s{s}", None if rng.random() < 0.05 else 273.15 + round(rng.random() * 3, digits), None if rng.random() < 0.1 else rng.random(), f"r{i}") for i, s in enumerate(rng.choices(range(7), k=160))]
    return rows, spark.createDataFrame(rows, "a string, b string, source string, t double, y double, rid string")


def test_gathered_rows_have_the_readings_and_the_fits(spark):
    rows, df = _told(spark, 1)
    got = blocks.source_rows(df, K, "source", "t", "y", ["rid"], fitted=True, whole=True)
    for r in got.collect():
        own = [x for x in rows if x[2] == r["source"] and x[1] == r["b"]]
        first = {}
        for x in sorted(own, key=lambda x: x[5]):
            if x[3] is not None:
                first.setdefault(round(x[3], 2), x[4])
        assert dict(zip(r["ts"], r["ys"], strict=True)) == first and r["n"] == len(own)
        assert sorted(zip(r["xs"], r["zs"], strict=True)) == sorted((x[3], x[4]) for x in own if x[3] is not None and x[4] is not None)
    both = [{x["source"]: tuple(x)[3:18] for x in d.collect()} for d in (fits.solved(got.drop("ts", "ys", "lo", "hi", "n", "xs", "zs"), [*K, "source"]), fits.apelblat_fits(df, [*K, "source"], "t", "y"))]
    assert both[0].keys() == both[1].keys() and all(both[0][s] == pytest.approx(both[1][s], rel=1e-4) for s in both[0])


def test_tier_rows_read_lineitem_once(spark, monkeypatch):
    def again(*_):
        raise AssertionError("lineitem was read again")

    monkeypatch.setattr(queries_audit, "measurements", again)
    assert registry.QUERIES["tier_rows"](spark, DIR).limit(1).count() == 1


@pytest.mark.parametrize("block", [2, 3072])
def test_near_readings_are_made_where_blocks_meet(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    rows, df = _told(spark, 2)
    got = blocks.near_readings(blocks.source_rows(df, K, "source", "t", "y", ["rid"], ranked=True), K, "source")
    assert "Join" not in got.select(F.col("t1"))._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]
    want = []
    for x in rows:
        near = {}
        for z in sorted(rows, key=lambda z: z[5]):
            if x[1] == z[1] and x[2] < z[2] and None not in (x[3], z[3]) and abs(z[3] - x[3]) < 0.1:
                near.setdefault(z[2], z)
        want += [(*x[:3], s, x[3], x[4], z[3], z[4]) for s, z in near.items()]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and want
