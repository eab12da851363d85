"""Every registered query with SQL gives what DuckDB gives, in columns and rows."""

import math
from decimal import Decimal

import duckdb
import pytest

from brindle.plans import registry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, Decimal):
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df, rel = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    ours = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(map(plain, r)) for r in rel.select(*order).fetchall())
    assert ours == theirs


def test_every_query_has_a_name_and_runs(spark):
    for name, query in registry.QUERIES.items():
        if name not in registry.ORACLE_SQL:
            assert query(spark, "/root/testdata/sf0.001").limit(1).count() >= 0, name
