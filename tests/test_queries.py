"""Every registered geoprocessing query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from cartolith import queries as tools

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(tools.QUERIES))
def test_query(spark, duck, name):
    found = tools.QUERIES[name](spark, SF).toPandas()
    if name not in tools.ORACLE_SQL:
        assert list(found.columns)
        return
    expected = duck.execute(tools.ORACLE_SQL[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    a, b = (d[columns].sort_values(columns, ignore_index=True).astype(object) for d in (found, expected))
    a, b = a.where(a.notna(), None), b.where(b.notna(), None)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_flagship(spark):
    assert tools.flagship(spark, SF).count() > 0
