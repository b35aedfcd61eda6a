"""Every registered analytics query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from quantloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        c.sql(f"create view {t} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return c


def rows_of(df, columns):
    return sorted([tuple("null" if v is None or v != v else str(v) for v in row) for row in df[columns].itertuples(index=False)])


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    ours = registry.queries()[name](spark, sf_dir).toPandas()
    theirs = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    for c in columns:
        if theirs[c].dtype != ours[c].dtype and str(theirs[c].dtype).startswith("datetime"):
            ours[c] = ours[c].astype(theirs[c].dtype)
    assert rows_of(ours, columns) == rows_of(theirs, columns)
