"""The entry module's contract, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["graph_nodes", "import_resolution", "pack_truncate_tail", "grants", "p3_found", "p4_found", "md_links", "topp_filter"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"create view {file[:-8]} as select * from '{DATA}/{file}'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    text = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(map(text, r)) for r in df.select(*columns).collect())
    assert got == sorted(tuple(map(text, r)) for r in want.fetchall())
