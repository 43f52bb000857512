"""Every registered query against its DuckDB twin on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from merchlake.plans.catalogue import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(rows, columns):
    places = [columns.index(c) for c in sorted(columns)]

    def value(x):
        return round(float(x), 6) if isinstance(x, (float, Decimal)) else x

    return sorted(str(tuple(value(r[i]) for i in places)) for r in rows)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, DIR)
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(frame.columns)
    assert plain(frame.collect(), frame.columns) == plain(found.fetchall(), columns)
