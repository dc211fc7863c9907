"""Every core query that has SQL gives the same rows as DuckDB on the smallest tables."""

import decimal
import math
from collections import Counter
from pathlib import Path

import pytest

from spanforge.plans import registry

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view \"{p.stem}\" as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, (float, int, decimal.Decimal)) and not isinstance(v, bool):
        return round(float(v), 6) if math.isfinite(v) else str(v)
    return v


@pytest.mark.parametrize("name", sorted(registry.all_sql()))
def test_same_rows(spark, duck, name):
    df = registry.all_queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    cursor = duck.execute(registry.all_sql()[name])
    at = [x[0] for x in cursor.description]
    assert sorted(at) == columns
    mine = Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert mine == Counter(repr([plain(r[at.index(c)]) for c in columns]) for r in cursor.fetchall())
