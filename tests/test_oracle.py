"""Every audit query that SQL expresses equals DuckDB's result."""

import math

import duckdb
import pytest

from privaudit.plans import queries

TABLES = "orders lineitem documents embeddings labels".split()
NAMES = sorted(queries.oracle_sql())


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, duck, name):
    df = queries.queries()[name](spark, small)
    cursor = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    theirs = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=repr)
    assert mine == theirs


def test_every_query_is_known():
    assert set(queries.oracle_sql()) <= set(queries.queries())
