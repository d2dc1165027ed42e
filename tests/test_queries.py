"""Every query with SQL gives DuckDB's rows on the smallest test tables."""

import math
import os

import pytest

from corvane.queries import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value) or type(value).__name__ in ("NAType", "NaTType"):
        return "null"
    if hasattr(value, "item"):
        value = value.item()
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    got, want = registry.queries()[name](spark, FOLDER).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False)) for df in (got, want)]
    assert rows[0] == rows[1]


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
