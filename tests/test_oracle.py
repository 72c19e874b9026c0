"""Every query with an oracle gives the oracle's rows on the smallest tables that exercise it."""

import math
import os

import pytest

from geoweave.plans.queries import ORACLES, QUERIES
from geoweave.plans.views import TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _rows(rows):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v + 0.0:.5f}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert {c: TYPES.get(t, t) for c, t in got.dtypes} == kinds
    order = [want.columns.index(c) for c in columns]
    assert _rows(got.select(*columns).collect()) == _rows([tuple(r[i] for i in order) for r in want.fetchall()])


def test_rows_only_queries_give_rows(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, DATA).count() > 0
