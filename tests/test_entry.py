import glob
import os

import pytest

import __spark_entry__ as entry
from lyrebird.queries import ORACLE, QUERIES


def test_contract(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def rows(table):
    cols = sorted(table.column_names)
    return cols, sorted((tuple(round(r[c], 6) if isinstance(r[c], float) else str(r[c]) for c in cols) for r in table.to_pylist()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert rows(QUERIES[name](spark, data).toArrow()) == rows(c.sql(ORACLE[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
