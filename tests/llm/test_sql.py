"""Registered queries of this folder against their SQL on DuckDB, over the given tables."""

import duckdb
import pytest

from fastbreak.llm.entries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    theirs = con.sql(ORACLE_SQL[name])
    ours = QUERIES[name](spark, SF)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert sorted(tuple(r) for r in ours.select(theirs.columns).collect()) == sorted(theirs.fetchall())
