"""Line items of the test tables with defects put in by rule, so that every quality rule has rows to find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_defects(li: DataFrame) -> DataFrame:
    """Defects by order number: lines written twice, and lines without a key, with values out of range or blank ends.

    Fixed values: the divisors of the order number that choose the lines.
    """
    order = F.col("order_id").cast("long")
    twice = li.unionAll(li.where(order % 101 == 0))
    return (
        twice.withColumn("row_id", F.when(order % 103 == 0, F.lit(None)).otherwise(F.col("row_id")))
        .withColumn("sales", F.when(order % 107 == 0, -F.col("sales")).otherwise(F.col("sales")).cast("decimal(10,2)"))
        .withColumn("quantity", F.when(order % 109 == 0, F.lit(0)).otherwise(F.col("quantity")))
        .withColumn("discount", F.when(order % 113 == 0, F.col("discount") + 1).otherwise(F.col("discount")).cast("decimal(4,2)"))
        .withColumn("customer_name", F.when(order % 127 == 0, F.concat(F.lit(" "), "customer_name")).otherwise(F.col("customer_name")))
        .withColumn("customer_id", F.when(order % 101 == 0, F.lit(None)).otherwise(F.col("customer_id")))
    )
