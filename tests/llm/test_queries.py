import glob
import os

import duckdb
import pytest
from lexforge.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    assert rows and len({map(str, r) for r in rows}) > 0
    if name in queries.ORACLES:
        con = duckdb.connect()
        for f in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        assert sorted(rows) == sorted(con.execute(queries.ORACLES[name]).fetchall())
