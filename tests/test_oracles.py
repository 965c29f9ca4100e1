"""Every registered query of the library against its SQL, on the smallest tables where every query has rows."""

import math
import os

import pytest

from tarnwick.plans import registry

DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(rows):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(map(value, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DIR):
        pytest.skip(f"no tables in {DIR}")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    rows = got.select(*(f"`{c}`" for c in columns)).collect()
    assert rows
    if name in registry.ORACLE_SQL:
        found = duck.sql(registry.ORACLE_SQL[name])
        assert sorted(found.columns) == columns
        want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
        assert _plain(rows) == _plain(want)
