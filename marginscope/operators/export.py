"""Enriched export (O27), the shared dashboard filters (O28) and the four linked views.

The export is one row per line with three derived columns; every view of
the dashboard is an aggregate of it after the same filters, so the filters
are a plain function applied before any rollup (and pushed to the scan).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import profit_flag, tier_expr
from ..sources.csv import CORRUPT, read_csv_raw, write_csv
from ..sources.schema import COLUMNS, LINE_ITEM_SCHEMA


def enriched_export(df: DataFrame, sort: bool = True) -> DataFrame:
    """All line-item columns plus days_to_ship, discount_tier and profit_flag.

    Sorted by row_id with a range-partitioned sort (no single task); a row id
    that is text sorts as text.
    """
    cols = []
    for c in COLUMNS:
        if c in ("sales", "profit", "discount"):
            cols.append(F.col(c).cast("double").alias(c))
        else:
            cols.append(F.col(c))
        if c == "ship_date":
            cols.append(F.datediff(F.col("ship_date"), F.col("order_date")).alias("days_to_ship"))
    cols += [tier_expr("discount").alias("discount_tier"), profit_flag("profit").alias("profit_flag")]
    out = df.select(*cols)
    return out.orderBy(F.col("row_id").asc_nulls_last()) if sort else out


def write_extract(
    df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite", charset: str = "utf-8", compression: str = "none"
) -> str:
    """Write the extract by partitions; CSV by the lossless writer of the CSV sink, in files of bounded size."""
    if fmt == "csv":
        return write_csv(df, path, charset, mode=mode, compression=compression)
    df.write.mode(mode).format(fmt).save(path)
    return path


EXPORT_TYPES = {"days_to_ship": T.IntegerType(), "sales": T.DoubleType(), "discount": T.DoubleType(), "profit": T.DoubleType()}


def read_extract(spark: SparkSession, path: str, row_id: str = "string") -> DataFrame:
    """Read an extract written as CSV back with its types."""
    names = [c for c in COLUMNS for c in ((c, "days_to_ship") if c == "ship_date" else (c,))] + ["discount_tier", "profit_flag"]
    base = {f.name: f.dataType for f in LINE_ITEM_SCHEMA.fields} | EXPORT_TYPES | {"row_id": T.StringType() if row_id == "string" else T.IntegerType()}
    schema = T.StructType([T.StructField(c, base.get(c, T.StringType())) for c in names])
    return read_csv_raw(spark, path, schema, charset="utf-8", multi_line=True).drop(CORRUPT)


def apply_filters(
    df: DataFrame,
    regions: Sequence[str] | None = None,
    categories: Sequence[str] | None = None,
    segments: Sequence[str] | None = None,
    date_range: tuple[date | str, date | str] | None = None,
    date_col: str = "order_date",
) -> DataFrame:
    """Dashboard filters: IN lists and an inclusive date range (pushed to the scan).

    On a table written with ``partition_by=["order_year"]`` the date range is
    also applied to the partition column, so whole year directories are
    skipped.
    """
    out = df
    if regions:
        out = out.where(F.col("region").isin(list(regions)))
    if categories:
        out = out.where(F.col("category").isin(list(categories)))
    if segments:
        out = out.where(F.col("segment").isin(list(segments)))
    if date_range:
        lo, hi = (F.lit(x).cast("date") for x in date_range)
        out = out.where(F.col(date_col).between(lo, hi))
        if date_col == "order_date" and "order_year" in df.columns:
            # a table partitioned by order year: the same range as a partition filter skips directories
            out = out.where(F.col("order_year").between(F.year(lo), F.year(hi)))
    return out


def dashboard_views(df: DataFrame, **filters) -> dict[str, DataFrame]:
    """The four linked dashboard views over one filtered line-item frame.

    Every view is an aggregate of the same filtered rows, so a region,
    category, segment or date filter acts on all of them at once (and
    reaches the parquet scan of each).
    """
    from .discount import discount_trend
    from .rollup import margin_rollup
    from .trends import period_rollup

    f = apply_filters(df, **filters)
    return {
        "profit_by_state": margin_rollup(f, ["state"], order=["total_profit"]),
        "profit_by_subcategory": margin_rollup(
            f, ["category", "sub_category"],
            ["total_sales", "total_profit", "profit_margin_pct", "avg_discount", "line_items"], order=["total_profit"]),
        "monthly_sales_profit": period_rollup(f),
        "discount_vs_profit": discount_trend(f),
    }
