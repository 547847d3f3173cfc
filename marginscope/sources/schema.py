"""The line-item table: one row per order line, 21 declared columns."""

from __future__ import annotations

from pyspark.sql import types as T

LINE_ITEM_SCHEMA = T.StructType([
    T.StructField("row_id", T.StringType()),
    T.StructField("order_id", T.StringType()),
    T.StructField("order_date", T.DateType()),
    T.StructField("ship_date", T.DateType()),
    T.StructField("ship_mode", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("customer_name", T.StringType()),
    T.StructField("segment", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("postal_code", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("sub_category", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("sales", T.DecimalType(10, 2)),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("discount", T.DecimalType(4, 2)),
    T.StructField("profit", T.DecimalType(10, 2)),
])

COLUMNS = [f.name for f in LINE_ITEM_SCHEMA.fields]

# Schema of a CSV export of the source system: row_id is the integer line number there.
CSV_SCHEMA = T.StructType(
    [T.StructField("row_id", T.IntegerType())] + LINE_ITEM_SCHEMA.fields[1:]
)

# The columns the completeness profile checks, the categorical
# columns whose domains are listed, the declared text widths, and the
# business key of the apparent-duplicate report.
NULL_CHECKED = [
    "row_id", "order_id", "order_date", "ship_date", "customer_id", "customer_name",
    "region", "state", "category", "sub_category", "sales", "quantity", "discount", "profit",
]

DOMAIN_COLUMNS = ["segment", "region", "category", "sub_category", "ship_mode", "state"]

# (text widths are enforced as a data-quality rule, not by the type)
VARCHAR_WIDTH = {
    "order_id": 20, "ship_mode": 50, "customer_id": 20, "customer_name": 100, "segment": 50,
    "country": 50, "city": 50, "state": 50, "postal_code": 10, "region": 20, "product_id": 20,
    "category": 50, "sub_category": 50, "product_name": 200,
}

# (apparent duplicates on the business key are reported, never removed)
BUSINESS_KEY = ["order_id", "product_id", "customer_id", "order_date"]
