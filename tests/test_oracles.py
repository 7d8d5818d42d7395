"""Queries against their SQL: all but those whose parts other queries here hold too. The driver compares all of them."""

import duckdb
import pandas as pd
import pytest

from loomgraph import catalogue
from loomgraph.projection import TABLES

#: Their results are in impact_report, or their traversal in impact_traverse.
ALIKE = {"impact_paths", "impact_context", "impact_implementation", "impact_validation"}


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple("" if pd.isna(v) else str(float(v)) if isinstance(v, (int, float)) else str(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - ALIKE))
def test_query_equals_sql(spark, sf, con, name):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), con.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
