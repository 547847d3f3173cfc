"""Exact money, ratio and mean expressions.

Money is DECIMAL(10,2) on every line. Sums stay decimal (exact, mergeable
partial aggregates); ratios are divided and rounded in decimal and only the
rounded value is cast to DOUBLE for the report. Every denominator goes
through ``nullif(…, 0)`` so an empty or zero group yields NULL instead of a
DIVIDE_BY_ZERO error under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column, den: Column, digits: int, scale: int = 1) -> Column:
    """round(num * scale / den, digits) in decimal; NULL when den is 0 or NULL."""
    n = num * F.lit(scale) if scale != 1 else num
    return F.round(n / F.nullif(den, F.lit(0)), digits).cast("double")


def pct(num: Column, den: Column, digits: int = 2) -> Column:
    """Percentage num/den*100 rounded half away from zero."""
    return ratio(num, den, digits, scale=100)


def share_pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """part / whole * 100 for integer counts, divided exactly in decimal."""
    return pct(part.cast("decimal(20,0)"), whole.cast("decimal(20,0)"), digits)


def margin_pct(profit: str | Column = "profit", sales: str | Column = "sales", digits: int = 2) -> Column:
    """ROUND(SUM(profit) / SUM(sales) * 100, digits) as an aggregate."""
    return pct(F.sum(_c(profit)), F.sum(_c(sales)), digits)


def mean(c: str | Column, digits: int) -> Column:
    """ROUND(AVG(c), digits) without double rounding.

    ``avg`` of a narrow decimal keeps only a few extra digits and would round
    twice; dividing the exact decimal sum by the count keeps 20 digits.
    """
    x = _c(c)
    n = F.count(x).cast("decimal(20,0)")
    return F.round(F.sum(x) / F.nullif(n, F.lit(0)), digits).cast("double")


def count_rows() -> Column:
    return F.count(F.lit(1))
