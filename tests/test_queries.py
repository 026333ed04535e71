"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from sluice.plans import queries as plans

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def value(v):
    """Decimals count as the numbers that they are."""
    return f"{v:.6f}" if isinstance(v, float | Decimal) else str(v)


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, str(DATA))
    want = duck.sql(plans.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = Counter(tuple(value(r[c]) for c in columns) for r in df.collect())
    at = [want.columns.index(c) for c in columns]
    assert got == Counter(tuple(value(r[i]) for i in at) for r in want.fetchall())


def test_every_query_has_sql():
    assert set(plans.SQL) == set(plans.QUERIES)
