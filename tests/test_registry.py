"""Every registered query with SQL against DuckDB; the others must run."""

import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from trailmill.plans import registry, registry_lines, registry_ml, registry_models, registry_more, registry_rest, registry_space  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def cell(x):
    if x is None or x is pd.NA or (isinstance(x, float | np.floating) and x != x):
        return None
    if isinstance(x, bool | np.bool_):
        return bool(x)
    if isinstance(x, int | float | np.number):
        return round(float(x), 7) + 0.0
    return str(x)


def rows(df):
    return Counter(tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
