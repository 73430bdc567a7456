"""Every query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from stratum import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def frame(df, columns):
    """Rows in one order and as text, floats to nine digits."""
    cell = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 9) if isinstance(v, float) else v
    return df[columns].map(cell).astype(str).sort_values(columns).reset_index(drop=True)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, db, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), db.sql(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    pd.testing.assert_frame_equal(frame(got, columns), frame(want, columns))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_without_sql(spark, name):
    """Rows only; what they hold is tested by operator."""
    found = queries.queries()[name](spark, SF)
    assert found.columns and found.count() > 0


def test_entry_and_guard(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
