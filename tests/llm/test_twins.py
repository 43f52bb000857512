"""Queries that have a DuckDB twin give its rows."""

import duckdb
import pytest

from merchlake.llm.entries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op3_substrings", "op4_decoded", "op5_suffixes", "op6_jaccard", "op9_embeddings", "op12_search", "op13_fingerprints"])
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(want.fetchall())
