"""Every registered query against its SQL twin on the smallest test data."""

import duckdb
import pandas as pd
import pytest
from conftest import SF_DIR

import __spark_entry__ as entry_module

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return c


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return None
    if isinstance(v, str):
        return v
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return round(float(v), 9)


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False, name=None)), key=repr)


def test_every_query_has_a_twin():
    """Corpus queries that SQL can't express are held against plain Python by their own tests."""
    twins = set(entry_module.oracle_sql())
    assert twins <= set(entry_module.queries())
    assert set(entry_module.queries()) - twins <= set(entry_module.CORPUS_QUERIES)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_matches_twin(spark, con, name):
    got = entry_module.queries()[name](spark, SF_DIR).toPandas()
    want = con.execute(entry_module.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
    assert len(got) > 0
