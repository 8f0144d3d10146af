"""Every query runs over its whole tables at the smallest scale, and agrees with its SQL where it has one."""

import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest
from lexforge.plans import catalog

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = sorted(repr(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    if name in catalog.ORACLES:
        out = duck.execute(catalog.ORACLES[name])
        names = [c[0] for c in out.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        assert sorted(names) == sorted(df.columns)
        assert rows == sorted(repr(tuple(plain(r[i]) for i in order)) for r in out.fetchall())


def test_core_does_not_import_llm():
    code = "import sys, lexforge.plans.catalog, lexforge.streaming.jobs, lexforge.sources.ingest; sys.exit(any(m.startswith('lexforge.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False).returncode == 0
