"""Every registered query with SQL gives DuckDB's rows; the others run and have columns."""

import datetime
import decimal

import pytest
from gazetta import catalog

from .conftest import SMALL


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(name, spark, duck):
    df = catalog.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    found = sorted((tuple(map(plain, r)) for r in df.select(cols).collect()), key=repr)
    cur = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert found == sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(name, spark):
    df = catalog.QUERIES[name](spark, SMALL)
    assert df.columns and df.count() >= 0
