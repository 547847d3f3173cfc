"""Every registered query equals its DuckDB oracle (sf0.001, order-insensitive)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001
from marginscope.plans import ORACLE, QUERIES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "date": "DATE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF001, t + '.parquet')}')")
    return c


def _norm(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        out.append(tuple("None" if r[i] is None else repr(r[i] + 0.0) if isinstance(r[i], float) else str(r[i])
                         for i in order))
    return sorted(out)


def test_every_report_has_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


# Reports sorted by a unique key: their order is compared as well.
ORDERED = ("discount_tiers", "discount_buckets", "by_discount_level", "monthly_running_total", "mom_growth", "moving_avg_3m",
           "monthly_margin", "monthly_summary", "ship_speed_by_year", "domain_counts", "top_customers", "multi_region_accounts")


@pytest.mark.parametrize("name", sorted(ORDERED))
def test_order(spark, con, name):
    df = QUERIES[name](spark, SF001)
    res = con.execute(ORACLE[name])
    place = [[d[0] for d in res.description].index(c) for c in df.columns]
    assert [_norm(df.columns, [tuple(r)]) for r in df.collect()] == [_norm(df.columns, [[r[i] for i in place]]) for r in res.fetchall()]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_parity(spark, con, name):
    df = QUERIES[name](spark, SF001)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    otypes = {d[0]: str(d[1]) for d in res.description}
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    for f in df.schema.fields:
        assert TYPES.get(f.dataType.simpleString()) == otypes[f.name], f.name
    assert len(srows) == len(orows)
    assert _norm(df.columns, srows) == _norm(ocols, orows)


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns[0] == "discount_tier"
    assert df.count() == 4
