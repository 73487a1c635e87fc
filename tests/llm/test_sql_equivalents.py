"""Queries of the subpackage that SQL can express, against DuckDB."""

import pytest

from lumipair.llm.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    ours = QUERIES[name](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    theirs = con.execute(ORACLES[name]).df().sort_values("doc_id").reset_index(drop=True)
    assert sorted(ours.columns) == sorted(theirs.columns)
    for column in theirs.columns:
        assert ours[column].tolist() == theirs[column].tolist(), column


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
