"""Every query of the core runs, and those with SQL give DuckDB's rows, on the smallest tables."""

import math
import os

import duckdb
import pytest

from codelode.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are absent")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, FOLDER)
    rows, cols = df.collect(), sorted(df.columns)
    if name in catalogue.oracle_sql():
        r = con.execute(catalogue.oracle_sql()[name])
        at = {d[0]: i for i, d in enumerate(r.description)}
        assert sorted(at) == cols
        assert sorted(tuple(plain(x[c]) for c in cols) for x in rows) == sorted(tuple(plain(x[at[c]]) for c in cols) for x in r.fetchall())
    else:
        assert rows is not None
