"""Queries of the text operators against their SQL on the smallest data."""

import glob
import os

import duckdb
import pytest

from segmill.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    sf = SF.replace("0.001", "0.01") if name == "p9_invariants" else SF  # a hundred documents can't be mixed to a hundredth
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == sorted(repr([dict(zip(names, r, strict=True))[c] for c in cols]) for r in found.fetchall())
