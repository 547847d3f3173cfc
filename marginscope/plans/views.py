"""Expose the line-item table to Spark SQL under the name the source reports use.

Existing SQL written against a single ``orders`` line-item table runs as is
on Spark SQL (CTEs, derived tables, ``COUNT(*) FILTER (WHERE …)``, RANK /
NTILE / LAG, nested ``SUM(SUM(x)) OVER``, ``DATE_TRUNC``, ``EXTRACT``,
``NULLIF``, ``USING`` joins, scalar subqueries). Two PostgreSQL forms differ
in Spark and have to be rewritten:

* ``date - date`` is an interval in Spark: use ``datediff(ship_date, order_date)``;
* ``TO_CHAR(d, 'Month')`` is not a Spark pattern: use ``date_format(d, 'MMMM')``.

Decimal ``AVG`` keeps only four extra digits in Spark; the operators in this
package divide exact sums instead (see ``functions.money.mean``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def register_line_items(df: DataFrame, name: str = "orders") -> str:
    """Register ``df`` as a temporary view ``name`` (session-scoped, lazy)."""
    df.createOrReplaceTempView(name)
    return name
