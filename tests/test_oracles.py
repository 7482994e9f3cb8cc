"""Every registered query that has oracle SQL is compared with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tracelode.plans import registry

TABLES = sorted(registry.TABLES)


def plain(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return f"{float(x):.6g}"
    if isinstance(x, (list, tuple)):
        return str([plain(v) for v in x])
    return x.isoformat() if hasattr(x, "isoformat") else str(x)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(str(plain(r[c])) for c in columns) for r in df.collect())
    found = duck.sql(registry.oracles()[name])
    assert sorted(found.columns) == columns
    place = [found.columns.index(c) for c in columns]
    want = sorted(tuple(str(plain(r[i])) for i in place) for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_query_without_oracle_runs(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    assert df.columns and df.count() > 0
