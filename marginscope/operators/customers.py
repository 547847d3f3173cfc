"""Customer reports.

Region is a property of the order line, not of the customer, so one
customer can appear under several regions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import margin_pct, mean, pct
from .ranking import ntile_distributed
from .rollup import distinct_orders

# Keys of the customer aggregate: every customer-level report groups by a subset of them.
CUBE_KEYS = ("customer_name", "segment", "region")


def customer_cube(df: DataFrame) -> DataFrame:
    """Exact additive measures per (customer, segment, region).

    Line count, sales, profit, discount sum and discount count are all
    additive, so every customer-level report can be computed from these
    rows instead of from the lines (distinct orders cannot, and stay on the
    lines). Materialise it once (``checkpoint``) to share it between reports.
    """
    return df.groupBy(*CUBE_KEYS).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("sales").alias("_s"),
        F.sum("profit").alias("_p"),
        F.sum("discount").alias("_ds"),
        F.count("discount").alias("_dn"),
    )


# Re-aggregated cube sums are cast back to the width a direct sum of the lines
# has, so every ratio is divided at the same decimal precision as on the lines.
def _s():
    return F.sum("_s").cast("decimal(20,2)")


def _p():
    return F.sum("_p").cast("decimal(20,2)")


def _mean_discount(digits: int):
    n = F.sum("_dn").cast("decimal(20,0)")
    return F.round(F.sum("_ds").cast("decimal(14,2)") / F.nullif(n, F.lit(0)), digits).cast("double")


def customer_metrics(df: DataFrame, key: str = "customer_name", cube: DataFrame | None = None) -> DataFrame:
    """Per-customer sales, profit, margin and average discount (decimal sums kept).

    With ``cube`` (``customer_cube`` of the same lines) the sums come from it.
    """
    if cube is not None and key == "customer_name":
        return cube.groupBy(key).agg(
            _s().alias("total_sales"),
            _p().alias("total_profit"),
            pct(_p(), _s(), 2).alias("margin_pct"),
            _mean_discount(4).alias("avg_discount"),
        )
    return df.groupBy(key).agg(
        F.sum("sales").alias("total_sales"),
        F.sum("profit").alias("total_profit"),
        margin_pct().alias("margin_pct"),
        mean("discount", 4).alias("avg_discount"),
    )


def top_customers(
    df: DataFrame, n: int = 10, key: str = "customer_name", with_avg_discount: bool = True,
    orders: DataFrame | None = None,
) -> DataFrame:
    """Top ``n`` customers by profit (ties broken by name): a per-task top-k then a merge.

    With ``orders`` (``order_aggregate`` of ``df``) the distinct orders and
    sums are taken from its one-row-per-order rows instead of the lines.
    """
    if orders is not None and key == "customer_name":
        aggs = [
            distinct_orders([key]).alias("num_orders"),
            _s().cast("double").alias("total_sales"),
            _p().alias("tp"),
        ]
        if with_avg_discount:
            aggs.append(_mean_discount(4).alias("avg_discount"))
        out = orders.groupBy(key).agg(*aggs)
    else:
        aggs = [
            F.count_distinct("order_id").alias("num_orders"),
            F.sum("sales").cast("double").alias("total_sales"),
            F.sum("profit").alias("tp"),
        ]
        if with_avg_discount:
            aggs.append(mean("discount", 4).alias("avg_discount"))
        out = df.groupBy(key).agg(*aggs)
    out = out.orderBy(F.col("tp").desc_nulls_first(), F.col(key).asc_nulls_last()).limit(n)
    cols = [key, "num_orders", "total_sales", F.col("tp").cast("double").alias("total_profit")]
    if with_avg_discount:
        cols.append("avg_discount")
    return out.select(*cols)


def sales_deciles(df: DataFrame, buckets: int = 10, key: str = "customer_name", cube: DataFrame | None = None) -> DataFrame:
    """Customer metrics with NTILE(``buckets``) by sales descending (name breaks ties)."""
    order = [F.col("total_sales").desc_nulls_first(), F.col(key).asc_nulls_last()]
    return ntile_distributed(customer_metrics(df, key, cube), buckets, order, name="sales_decile")


def _thin(df: DataFrame, buckets: int, bucket: int, max_margin: float, key: str, deciles: DataFrame | None) -> DataFrame:
    d = sales_deciles(df, buckets, key) if deciles is None else deciles
    return d.where((F.col("sales_decile") == bucket) & (F.col("margin_pct") < max_margin))


def thin_margin_accounts(
    df: DataFrame,
    buckets: int = 10,
    bucket: int = 1,
    max_margin: float = 5,
    key: str = "customer_name",
    columns: Sequence[str] = ("total_sales", "total_profit", "margin_pct", "avg_discount"),
    deciles: DataFrame | None = None,
) -> DataFrame:
    """Customers in the top sales bucket whose (rounded) margin is below ``max_margin`` %.

    ``deciles`` is an already computed ``sales_deciles(df, buckets, key)``
    (shared by several reports over the same table); computed here if absent.
    """
    kept = _thin(df, buckets, bucket, max_margin, key, deciles)
    cast = {"total_sales": F.col("total_sales").cast("double"), "total_profit": F.col("total_profit").cast("double")}
    return kept.orderBy(F.col("total_sales").desc_nulls_first(), key).select(
        key, *[cast.get(c, F.col(c)).alias(c) for c in columns]
    )


def flagged_accounts(
    df: DataFrame, buckets: int = 10, bucket: int = 1, max_margin: float = 5, key: str = "customer_name",
    deciles: DataFrame | None = None,
) -> DataFrame:
    """Keys of the thin-margin accounts (unordered; input of a semi-join)."""
    return _thin(df, buckets, bucket, max_margin, key, deciles).select(key)


def account_profile(
    df: DataFrame,
    accounts: DataFrame | Sequence[str] | str,
    by: Sequence[str] = ("segment", "region"),
    key: str = "customer_name",
    digits: int = 3,
    discount_name: str = "avg_discount_given",
    with_sales: bool = True,
    cube: DataFrame | None = None,
) -> DataFrame:
    """Discount and profit profile of chosen accounts per ``by``.

    ``accounts`` is a name, a list of names (a pushed-down IN filter, applied
    before the aggregate) or a DataFrame of keys. With ``cube`` (and ``by``
    within its keys) the sums come from the customer aggregate. A key DataFrame is not
    size-bounded, so the lines are aggregated first (partial aggregation
    collapses them map-side) and only the per-group rows meet the key set in
    a semi-join: the same result, with a shuffle of groups instead of lines.
    """
    from_cube = cube is not None and key == "customer_name" and set(by) <= set(CUBE_KEYS)
    if from_cube:
        df = cube
        aggs = [_mean_discount(digits).alias(discount_name), F.sum("_n").alias("num_orders")]
        if with_sales:
            aggs.append(_s().cast("double").alias("total_sales"))
        aggs.append(_p().alias("tp"))
    else:
        aggs = [mean("discount", digits).alias(discount_name), F.count(F.lit(1)).alias("num_orders")]
        if with_sales:
            aggs.append(F.sum("sales").cast("double").alias("total_sales"))
        aggs.append(F.sum("profit").alias("tp"))
    if isinstance(accounts, DataFrame) and from_cube:
        # the cube already has one row per group: only the accounts' rows are grouped
        out = df.join(accounts.select(key), key, "left_semi").groupBy(key, *by).agg(*aggs)
    elif isinstance(accounts, DataFrame):
        out = df.groupBy(key, *by).agg(*aggs).join(accounts.select(key), key, "left_semi")
    else:
        names = [accounts] if isinstance(accounts, str) else list(accounts)
        lines = df.where(F.col(key) == names[0]) if len(names) == 1 else df.where(F.col(key).isin(names))
        out = lines.groupBy(key, *by).agg(*aggs)
    out = out.orderBy(F.col("tp").asc_nulls_last(), key, *by)
    return out.withColumn("tp", F.col("tp").cast("double")).withColumnRenamed("tp", "total_profit")


def versus_company(
    profile: DataFrame, df: DataFrame, digits: int = 3, discount_name: str = "avg_discount_given", cube: DataFrame | None = None,
) -> DataFrame:
    """Add the company-wide average discount and the gap to it.

    The company average is an uncorrelated scalar subquery (one value),
    evaluated once and inlined, not a join. With ``cube`` it comes from the
    customer aggregate's exact sums instead of the lines.
    """
    if cube is not None:
        total, n = F.sum("_ds").cast("decimal(14,2)"), F.sum("_dn").cast("decimal(20,0)")
    else:
        total, n = F.sum("discount"), F.count("discount").cast("decimal(20,0)")
    company = (df if cube is None else cube).agg(F.round(total / F.nullif(n, F.lit(0)), digits).alias("c")).scalar()
    dec = f"decimal(12,{digits})"
    return profile.withColumn("company_avg_discount", company.cast("double")).withColumn(
        "discount_vs_company", (F.col(discount_name).cast(dec) - company.cast(dec)).cast("double")
    )


def account_detail(df: DataFrame, customer: str, key: str = "customer_name") -> DataFrame:
    """Line detail of one account ordered by region and date."""
    return (
        df.where(F.col(key) == customer)
        .select(
            "order_id", "order_date", "region", "sub_category",
            F.col("discount").cast("double").alias("discount"),
            F.col("sales").cast("double").alias("sales"),
            F.col("profit").cast("double").alias("profit"),
        )
        .orderBy("region", "order_date", "order_id")
    )


def multi_region_accounts(
    df: DataFrame, n: int | None = 20, key: str = "customer_name", min_regions: int = 2, cube: DataFrame | None = None,
) -> DataFrame:
    """Accounts active in at least ``min_regions`` regions, least profitable first."""
    from_cube = cube is not None and key == "customer_name"
    src, profit = (cube, _p()) if from_cube else (df, F.sum("profit"))
    out = (
        src.groupBy(key)
        .agg(F.count_distinct("region").alias("regions_active_in"), profit.alias("tp"))
        .where(F.col("regions_active_in") >= min_regions)
        .orderBy(F.col("tp").asc_nulls_last(), key)
    )
    if n is not None:
        out = out.limit(n)
    return out.select(key, "regions_active_in", F.col("tp").cast("double").alias("total_profit"))

