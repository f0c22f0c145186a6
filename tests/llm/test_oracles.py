"""The queries that SQL can express against DuckDB."""

import duckdb
import pytest

from tremolo.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, want.fetchall())) == sorted(tuple(r[c] for c in columns) for r in got.collect())
