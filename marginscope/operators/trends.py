"""Period series and their windows.

The windows (running total, LAG, moving average) have no partition key,
but they run only after the period rollup: one row per calendar month, so
the single window task sees a few hundred rows whatever the fact size.
Rollups take line items, or cells of a cuboid by month of ``order_date``
(for periods of a month and longer). Calendar gaps are not filled: LAG and the moving average use the previous
*existing* month, as in the source reports.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pct
from ..functions.additive import Additive

PERIOD_FORMATS = {"month": "MM", "quarter": "quarter", "year": "year"}


def period_col(date: str = "order_date", period: str = "month"):
    """First day of the period as a DATE (not a session-zone timestamp)."""
    return F.trunc(F.col(date), PERIOD_FORMATS[period])


def period_rollup(
    df: DataFrame,
    period: str = "month",
    date: str = "order_date",
    names: Sequence[str] = ("monthly_sales", "monthly_profit", "profit_margin_pct"),
    keep_decimal: bool = False,
) -> DataFrame:
    """Sales, profit and margin per period (``period`` column is a DATE)."""
    s, p, m = names
    of = Additive(df)
    out = df.groupBy(period_col(date, period).alias(period)).agg(
        of.total("sales").alias(s), of.total("profit").alias(p), of.margin_pct().alias(m)
    )
    if not keep_decimal:
        out = out.select(period, F.col(s).cast("double").alias(s), F.col(p).cast("double").alias(p), m)
    return out.orderBy(period)


def period_sales(df: DataFrame, period: str = "month", date: str = "order_date", name: str = "total_sales") -> DataFrame:
    """Exact (decimal) sales per period: the input of the series windows."""
    return df.groupBy(period_col(date, period).alias(period)).agg(Additive(df).total("sales").alias(name))


def _series_window(period: str):
    return Window.orderBy(period)


def running_total(series: DataFrame, value: str = "monthly_sales", period: str = "month", name: str = "running_total_sales") -> DataFrame:
    w = _series_window(period).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return series.select(
        period,
        F.col(value).cast("double").alias(value),
        F.sum(value).over(w).cast("double").alias(name),
    ).orderBy(period)


def period_growth(series: DataFrame, value: str = "total_sales", period: str = "month", prev_name: str = "prev_month_sales", name: str = "mom_growth_pct") -> DataFrame:
    """Previous period value and growth %; NULL for the first period or a zero base."""
    prev = F.lag(value, 1).over(_series_window(period))
    return (
        series.withColumn(prev_name, prev)
        .select(
            period,
            F.col(value).cast("double").alias(value),
            F.col(prev_name).cast("double").alias(prev_name),
            pct(F.col(value) - F.col(prev_name), F.col(prev_name), 2).alias(name),
        )
        .orderBy(period)
    )


def moving_average(series: DataFrame, value: str = "total_sales", n: int = 3, period: str = "month", name: str = "three_month_moving_avg") -> DataFrame:
    """Mean over the current and ``n - 1`` previous existing periods, exact decimal."""
    w = _series_window(period).rowsBetween(-(n - 1), Window.currentRow)
    avg = F.sum(value).over(w) / F.count(value).over(w).cast("decimal(20,0)")
    return series.select(
        period,
        F.col(value).cast("double").alias(value),
        F.round(avg, 2).cast("double").alias(name),
    ).orderBy(period)


def seasonality(df: DataFrame, date: str = "order_date") -> DataFrame:
    """Calendar month over all years, by sales descending."""
    of = Additive(df)
    out = df.groupBy(
        F.month(date).cast("bigint").alias("month_num"),
        F.date_format(date, "MMMM").alias("month_name"),
    ).agg(
        of.total("sales").cast("double").alias("total_sales"),
        of.total("profit").cast("double").alias("total_profit"),
        of.margin_pct().alias("profit_margin_pct"),
    )
    return out.orderBy(F.col("total_sales").desc_nulls_first(), "month_num")


def fulfilment(df: DataFrame, by: str = "ship_mode", with_count: bool = True) -> DataFrame:
    """Average days from order to shipment per ``by`` ('ship_mode' or 'order_year')."""
    key = F.year("order_date").cast("bigint").alias("order_year") if by == "order_year" else F.col(by)
    of = Additive(df)
    aggs = [of.mean("days_to_ship", 2).alias("avg_days_to_ship")]
    if with_count:
        aggs.append(of.count().alias("line_items"))
    out = df.groupBy(key).agg(*aggs)
    return out.orderBy("order_year") if by == "order_year" else out.orderBy("avg_days_to_ship", by)
