"""Operators against their statements in SQL, over the whole test tables."""

import duckdb
import pytest

from marginscope.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op9_ngram_join", "op13_suffix_dedup"])
def test_query_equals_sql(spark, name):
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        want = db.execute(queries.ORACLE[name])
        columns = [c[0] for c in want.description]
        want = sorted(want.fetchall())
    got = queries.QUERIES[name](spark, SF)
    assert set(columns) == set(got.columns)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == want
