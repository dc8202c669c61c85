"""Every registered query with SQL gives the rows of that SQL on the small tables."""

import duckdb
import pandas as pd
import pytest
from fieldtrace.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, db, data, name):
    got, want = rows(QUERIES[name](spark, data).toPandas()), rows(db.sql(ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=False, rtol=1e-12)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_without_sql(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
