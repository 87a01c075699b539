"""The registered queries of the subpackage against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from lodestone.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    rel = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in rel.description]
    want = sorted(map(repr, rel.fetchall()))
    got = queries.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(repr(tuple(r)) for r in got) == want


def test_held_out_toxicity(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [r for r in queries.op9_toxicity(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in rows)
    assert right / len(rows) > 0.95
