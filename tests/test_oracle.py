"""Every registered query with an oracle against DuckDB on the same files."""

import math

import duckdb
import pytest

from tremolo.plans import catalog

SF = "/root/testdata/sf0.001"
#: Kernels need blocks of 1024 points.
SF_WHOLE = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v.item() if hasattr(v, "item") else str(v) if not isinstance(v, (int, bool, str, type(None))) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
    right = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in want.fetchall()), key=key)
    left = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    assert len(left) == len(right)
    assert left == right


def test_queries_without_oracle_run(spark):
    for name in catalog.queries().keys() - catalog.oracle_sql().keys():
        assert catalog.queries()[name](spark, SF_WHOLE).count() > 0, name
