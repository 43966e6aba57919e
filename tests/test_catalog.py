"""Every query against its SQL."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def plain(x):
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, dict):
        return [plain(y) for y in x.values()]
    if isinstance(x, (float, decimal.Decimal)):
        return None if isinstance(x, float) and math.isnan(x) else round(float(x), 6) + 0.0
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)[:10]
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    want = db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(want.columns, want.fetchall())
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert a == b


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLES and not n.startswith("op") and n != "pipeline"))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0
