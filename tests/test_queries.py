"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from tidewire.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v) if isinstance(v, Decimal) or hasattr(v, "isoformat") else repr(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    names = ", ".join(f'"{c}"' for c in cols)
    rows = con.sql(f"SELECT {names} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert Counter(tuple(map(plain, r)) for r in df.select(*cols).collect()) == Counter(tuple(map(plain, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
