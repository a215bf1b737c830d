"""Every registered query that has an oracle gives the same rows as DuckDB."""

import datetime
import math

import duckdb
import pytest

from larkspur.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_matches_oracle(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    if name not in catalog.ORACLES:
        assert rows
        return
    cur = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == names
    at = [cols.index(c) for c in names]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in cur.fetchall())
