"""Every query with SQL gives the SQL's rows; the others run and have rows."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from spindrift.plans import catalog

catalog.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return "null"
        if isinstance(x, (float, np.floating)):
            return f"{float(x):.6f}"
        if isinstance(x, (int, np.integer, bool, np.bool_)):
            return f"{float(x):.6f}"
        return str(x)

    return sorted(tuple(map(cell, row)) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, data, db, name):
    found, wanted = catalog.QUERIES[name](spark, data).toPandas(), db.sql(catalog.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert plain(found) == plain(wanted)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.FLAGSHIP in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
