"""The numbered queries run on the smallest tables; those with SQL give DuckDB's rows."""

import os

import duckdb
import pytest

from codelode.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are absent")
FOUND = {"p1_found": ["file_id"], "p2_found": ["chunk_no", "line_no"], "p3_found": ["file_id"], "p4_found": ["chunk_a", "chunk_b"], "p5_found": ["chunk_no", "cut"], "p6_found": ["doc_id"], "p7_found": ["source"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    if name in FOUND:
        assert df.columns == FOUND[name] and len(rows) == len(set(rows))
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for f in os.listdir(FOLDER):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
        assert sorted(rows) == sorted(con.execute(queries.oracle_sql()[name]).fetchall())
