"""Every query with SQL gives the rows that DuckDB gives, at the smallest size."""

import math

import duckdb
import pytest

import __spark_entry__

SQL = __spark_entry__.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, sf_dir)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda row: tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)
    want = sorted((tuple(plain(x) for x in r) for r in cursor.fetchall()), key=key)
    have = sorted((tuple(plain(x) for x in r) for r in got.select(*[f"`{n}`" for n in names]).collect()), key=key)
    assert have == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(SQL) <= set(__spark_entry__.queries())
