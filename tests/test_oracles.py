"""Every registered query against its DuckDB twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import TABLES, rows_of

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{small}/{name}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "split", "pair_idx", "context", "target"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, db, name):
    ours = QUERIES[name](spark, small).toArrow()
    if name not in ORACLES:
        assert ours.num_rows > 0
        return
    theirs = db.sql(ORACLES[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert rows_of(ours) == rows_of(theirs)
