"""tolerance_join rounds a reading once, and not each of its matches."""

from tarnwick.operators import blocks
from tarnwick.plans import registry

DIR = "/root/testdata/sf0.01"


def test_matches_are_not_rounded_one_by_one(spark):
    """Before, four numbers of each match were rounded, which took most of the time."""
    plan = registry.QUERIES["tolerance_join"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    matches, below = plan.split("FlatMapGroupsInArrow", 1)
    assert "round(" not in matches and "round(" in below


def test_exact_temperatures_match_and_rounded_are_shown(spark, monkeypatch):
    rows = [("g", "a", 1.0, 0.12345678, 0), ("g", "b", 1.0999999, -0.0000001, 1), ("g", "c", 1.1000001, None, 2), ("g", "d", 0.9000004, 2.5, 3), ("g", "d", 1.0, 3.5, 4)]
    df = spark.createDataFrame(rows, "k string, source string, t double, y double, o long")
    made = blocks.source_rows(df, ["k"], "source", "t", "y", ["o"], ranked=True)
    want = [("a", "b", 1.0, 0.123457, 1.1, 0.0), ("a", "d", 1.0, 0.123457, 0.9, 2.5), ("b", "c", 1.1, 0.0, 1.1, None), ("b", "d", 1.1, 0.0, 1.0, 3.5)]
    for size in (3072, 1):
        monkeypatch.setattr(blocks, "BLOCK", size)
        got = sorted(tuple(r)[1:] for r in blocks.near_readings(made, ["k"], "source", digits=6).collect())
        assert got == want
        assert not any(str(r[k]) == "-0.0" for r in got for k in (3, 5))
