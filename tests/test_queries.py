"""Every named query against its SQL equivalent in DuckDB, on the smallest test tables."""

import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry_module  # noqa: E402
from lumipair.plans.oracles import ORACLES  # noqa: E402
from lumipair.plans.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = ["lineitem", "orders", "embeddings"]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


# Rounds of adapted draws; test_hierarchy.py compares them with a brute-force integral.
WITHOUT_SQL = {"hierarchical_posterior"}


def test_every_query_has_an_oracle():
    assert QUERIES.keys() - WITHOUT_SQL == ORACLES.keys()
    assert QUERIES.keys() <= entry_module.queries().keys() and ORACLES.keys() <= entry_module.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, tables, name):
    ours = QUERIES[name](spark, SF).toPandas()
    theirs = tables.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    exact = [c for c in sorted(ours.columns) if not pd.api.types.is_float_dtype(ours[c])]
    inexact = [c for c in sorted(ours.columns) if c not in exact]
    order = exact + inexact
    ours, theirs = (df[order].sort_values(order).reset_index(drop=True) for df in (ours, theirs))
    assert len(ours) == len(theirs)
    for c in exact:
        assert ours[c].tolist() == theirs[c].tolist(), c
    for c in inexact:
        np.testing.assert_allclose(ours[c].astype(float), theirs[c].astype(float), atol=1.5e-6, err_msg=c)


def test_entry(spark):
    found = entry_module.entry(spark).toPandas()
    assert len(found) == 6 and (found["bf"] > 0).all()
