import os

import duckdb
import pytest

import __spark_entry__ as e
from oracle_check import canon
from treefold.plans import queries as plain

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", plain.Q)
def test_against_sql(spark, name):
    got = plain.Q[name](spark, SF).toPandas()
    if name in plain.SQL:
        db = duckdb.connect()
        for f in os.listdir(SF):
            db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM read_parquet('{SF}/{f}')")
        want = db.sql(plain.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)
    assert len(got)


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
