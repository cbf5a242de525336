"""Every registered query with SQL against DuckDB on the smallest tables."""

import decimal

import duckdb
import pytest

from geomill.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return 0.0 if isinstance(v, float) and v == 0 else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    result = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(_value(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    got = sorted((tuple(_value(r[c]) for c in columns) for r in rows), key=str)
    assert got == want
