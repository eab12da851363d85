import duckdb
import pytest

from brindle.llm import queries

TABLES = ["documents", "pages", "benchmark", "labels", "conversations", "embeddings"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    rel = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, sf_small)
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in order) for r in df.collect()))) == sorted(map(str, rel.select(*order).fetchall()))
