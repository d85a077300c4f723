"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from stratacube.jobs import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return str(v)
    return v


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(want.columns)
    have, need = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert len(have) == len(need)
    for a, b in zip(have, need, strict=True):
        for x, y in zip(a, b, strict=True):
            assert abs(x - y) <= 2e-6 if isinstance(x, float) and isinstance(y, (int, float)) else x == y, (a, b)


def test_registry_has_sql_for_all_but_one_regression():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"quantile_regression"}
