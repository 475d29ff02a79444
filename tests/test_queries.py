"""Every survey query against DuckDB over the smallest tables."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb
import pytest

from cipherledger.plans.catalog import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    q = duck.execute(ORACLES[name])
    names = [c[0] for c in q.description]
    assert sorted(names) == cols
    want = sorted(str([plain(r[names.index(c)]) for c in cols]) for r in q.fetchall())
    assert got == want
