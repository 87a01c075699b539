"""Every registered query of the engine's own operators against its DuckDB SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lodestone.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLE_SQL:
        assert got.count() > 0
        return
    rel = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted([plain(x) for x in r] for r in rel.fetchall())
    assert sorted([plain(x) for x in r] for r in got.select(*columns).collect()) == want
