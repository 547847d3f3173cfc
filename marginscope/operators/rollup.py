"""Margin rollup (O8): one groupBy with any of the standard measures.

All measures are algebraic (sum / count) or exact distinct counts, so the
physical plan is a partial aggregate before the shuffle and a final one
after it: a hot group key is combined map-side and never lands whole in one
task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import count_rows, margin_pct, mean, pct
from ..functions.additive import Additive, is_cells

# Output name -> aggregate. Names follow the reports they come from;
# "num_orders" in the line-level reports counts line items, while
# "total_orders" counts distinct orders.
MEASURES: dict[str, Callable[[], Column]] = {
    "total_orders": lambda: F.count_distinct("order_id"),
    "num_orders": count_rows,
    "line_items": count_rows,
    "total_line_items": count_rows,
    "total_sales": lambda: F.sum("sales").cast("double"),
    "total_profit": lambda: F.sum("profit").cast("double"),
    "profit_margin_pct": lambda: margin_pct(),
    "margin_pct": lambda: margin_pct(),
    "avg_discount": lambda: mean("discount", 4),
    "avg_profit_per_order": lambda: mean("profit", 2),
}

STANDARD = ("total_sales", "total_profit", "profit_margin_pct")

# Keys of the order aggregate: an order and the customer attributes of its lines.
ORDER_KEYS = ("order_id", "customer_name", "segment")


def order_aggregate(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Exact additive measures per (order, customer, segment).

    Line count, sales, profit and the discount sum and count are additive. Distinct
    orders are made additive too: flags mark the first of an order's
    rows, and the first one for each of its customers and segments, so every
    rollup over these keys is a sum that combines before its shuffle.
    Materialise it once to share it. The flags sort the orders in ``parts`` partitions; without,
    adaptive execution decides by the compressed shuffle, of which a sort takes several times the memory.
    """
    rows = df.groupBy(*ORDER_KEYS).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("sales").alias("_s"),
        F.sum("profit").alias("_p"),
        F.sum("discount").alias("_ds"),
        F.count("discount").alias("_dn"),
    )

    if parts:
        rows = rows.repartition(parts, "order_id")

    def first(*keys: str) -> Column:
        # an order has few rows here: one for each customer and segment on it
        w = Window.partitionBy(*keys).orderBy(*[k for k in ORDER_KEYS if k not in keys])
        return (F.col("order_id").isNotNull() & (F.row_number().over(w) == 1)).cast("int")

    return (
        rows.withColumn("_o", first("order_id"))
        .withColumn("_o_customer_name", first("order_id", "customer_name"))
        .withColumn("_o_segment", first("order_id", "segment"))
        .withColumn("_o_both", F.col("order_id").isNotNull().cast("int"))
    )


def distinct_orders(dims: Sequence[str]) -> Column:
    """Number of distinct orders over ``order_aggregate`` rows grouped by ``dims``."""
    flag = "_o_both" if len(dims) > 1 else f"_o_{dims[0]}" if dims else "_o"
    return F.coalesce(F.sum(flag), F.lit(0)).cast("long")


def _resum(c: str, width: str) -> Column:
    # cast back to the width a direct sum of the lines has: ratios keep the same precision
    return F.sum(c).cast(width)


# The same measures over ``order_aggregate`` rows.
AGG_MEASURES: dict[str, Callable[[], Column]] = {
    "num_orders": lambda: F.sum("_n"),
    "line_items": lambda: F.sum("_n"),
    "total_line_items": lambda: F.sum("_n"),
    "total_sales": lambda: _resum("_s", "decimal(20,2)").cast("double"),
    "total_profit": lambda: _resum("_p", "decimal(20,2)").cast("double"),
    "profit_margin_pct": lambda: pct(_resum("_p", "decimal(20,2)"), _resum("_s", "decimal(20,2)"), 2),
    "margin_pct": lambda: pct(_resum("_p", "decimal(20,2)"), _resum("_s", "decimal(20,2)"), 2),
    "avg_discount": lambda: F.round(
        _resum("_ds", "decimal(14,2)") / F.nullif(F.sum("_dn").cast("decimal(20,0)"), F.lit(0)), 4
    ).cast("double"),
}

# The same measures over the cells of a cuboid (``operators.cuboids``); distinct orders are not additive.
CELL_MEASURES: dict[str, Callable[[Additive], Column]] = {
    "num_orders": lambda a: a.count(),
    "line_items": lambda a: a.count(),
    "total_line_items": lambda a: a.count(),
    "total_sales": lambda a: a.total("sales").cast("double"),
    "total_profit": lambda a: a.total("profit").cast("double"),
    "profit_margin_pct": lambda a: a.margin_pct(),
    "margin_pct": lambda a: a.margin_pct(),
    "avg_discount": lambda a: a.mean("discount", 4),
    "avg_profit_per_order": lambda a: a.mean("profit", 2),
}


def measure(name: str) -> Column:
    return MEASURES[name]().alias(name)


def margin_rollup(
    df: DataFrame,
    dims: Sequence[str | Column] = (),
    measures: Sequence[str | Column] = STANDARD,
    order: Sequence[str | Column] | None = None,
    orders: DataFrame | None = None,
) -> DataFrame:
    """Group by ``dims`` (empty = one global row) and compute ``measures``.

    A measure is a name from ``MEASURES`` or any aliased aggregate Column.
    ``order`` entries given as names sort ascending with NULLs last (the
    source reports' SQL default); pass Columns for any other order.
    ``orders`` (``order_aggregate`` of ``df``) is used instead of the lines
    when the dims are among its keys and every measure is a named one.
    ``df`` may also be the cells of a cuboid that keeps the dims.
    """
    use_orders = (
        orders is not None
        and all(isinstance(d, str) and d in ORDER_KEYS[1:] for d in dims)
        and all(isinstance(m, str) and (m in AGG_MEASURES or m == "total_orders") for m in measures)
    )
    if use_orders:
        df = orders
        aggs = [(distinct_orders(dims) if m == "total_orders" else AGG_MEASURES[m]()).alias(m) for m in measures]
    elif is_cells(df):
        of = Additive(df)
        aggs = [CELL_MEASURES[m](of).alias(m) if isinstance(m, str) else m for m in measures]
    else:
        aggs = [measure(m) if isinstance(m, str) else m for m in measures]
    out = df.groupBy(*dims).agg(*aggs) if dims else df.agg(*aggs)
    if not order:
        return out
    return out.orderBy(*[F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order])
