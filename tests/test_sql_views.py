"""SQL written against one line-item table runs on Spark SQL over the registered view."""

import pytest
from pyspark.sql.utils import AnalysisException

from marginscope.operators.discount import threshold_split
from marginscope.operators.rollup import margin_rollup
from marginscope.plans.views import register_line_items


@pytest.fixture(scope="module")
def orders(spark, li001):
    register_line_items(li001, "orders")
    return li001


def test_group_by_matches_operator(spark, orders):
    sql = spark.sql("SELECT region, SUM(profit) AS p FROM orders GROUP BY region").collect()
    op = margin_rollup(orders, ["region"], ["total_profit"]).collect()
    assert {r.region: float(r.p) for r in sql} == {r.region: r.total_profit for r in op}


def test_filter_clause_and_conditional_sum(spark, orders):
    rows = spark.sql("""
        SELECT sub_category,
               SUM(CASE WHEN discount > 0.2 THEN profit ELSE 0 END) AS above,
               COUNT(*) FILTER (WHERE discount > 0.2) AS n_above
        FROM orders GROUP BY sub_category""").collect()
    op = {r.sub_category: r for r in threshold_split(orders).collect()}
    for r in rows:
        assert float(r.above) == op[r.sub_category].profit_above_20pct
        assert r.n_above == op[r.sub_category].orders_above_20pct


def test_windows_over_aggregates(spark, orders):
    rows = spark.sql("""
        WITH m AS (SELECT DATE_TRUNC('month', order_date) AS month, SUM(sales) AS s FROM orders GROUP BY 1)
        SELECT month, s, SUM(s) OVER (ORDER BY month) AS running, LAG(s) OVER (ORDER BY month) AS prev,
               NTILE(4) OVER (ORDER BY s DESC, month) AS q
        FROM m ORDER BY month""").collect()
    assert len(rows) == 80 and rows[0].prev is None
    assert rows[-1].running == sum(r.s for r in rows)
    nested = spark.sql("""
        SELECT region, SUM(profit) AS p, RANK() OVER (PARTITION BY region ORDER BY SUM(profit) DESC) AS rk
        FROM orders GROUP BY region, sub_category""").collect()
    assert min(r.rk for r in nested) == 1


def test_documented_differences(spark, orders):
    with pytest.raises(AnalysisException):
        spark.sql("SELECT ROUND(AVG(ship_date - order_date), 2) FROM orders").collect()
    ok = spark.sql("SELECT ROUND(AVG(datediff(ship_date, order_date)), 2) AS d FROM orders").first()
    assert ok.d is not None
    with pytest.raises(Exception):
        spark.sql("SELECT TO_CHAR(order_date, 'Month') FROM orders").collect()
    assert spark.sql("SELECT date_format(DATE'2020-03-01', 'MMMM') AS m").first().m == "March"
