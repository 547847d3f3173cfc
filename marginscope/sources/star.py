"""Fixture adapter: TPC-H-style star tables -> denormalised line items.

The analysis model is one wide table of order line items. The test data
ships as a star schema, so this module derives the 21 line-item columns with
the join below. Every derived value is computed with integer or decimal
arithmetic only, so the DuckDB oracle (which runs the same expressions as a
CTE, see ``plans.oracle``) produces bit-identical money.

Join plan (designed for a fact table of billions of rows):

* nation |><| region is bounded by the TPC-H spec (25 and 5 rows at every
  scale factor), so it is the only side broadcast by hint.
* supplier, customer, part and orders grow with the scale factor (10k, 150k,
  200k and 1.5M rows per SF). The smallest are broadcast as long as their bytes,
  by counted rows, fit one joint budget (``within_budget``); the others are
  shuffle joins. (Spark's own estimate cannot be used here: without table statistics
  it sizes a join as the product of its inputs, so orders |><| customer would
  look larger than the fact table and the fact table would be broadcast.)
* A line is narrow while it is shuffled: whole numbers and dates, no text that can be made or
  looked up later. Dimensions too large to broadcast are joined first (customer to orders, *before*
  they meet lineitem); then the lines are clustered by date, if asked for; the broadcast
  dimensions and the text columns come last, without a shuffle.
* A fact table of under ``NARROW_ROWS`` lines is dealt out before the joins;
  larger ones have enough splits and no shuffle is added.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import row_bytes, row_counts, within_budget

STAR_TABLES = ("lineitem", "orders", "customer", "supplier", "nation", "region", "part")

# Declared input schemas of the star tables (FIXTURES.md section 3). Reading
# with a declared schema skips a footer-inference job per table.
STAR_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}

# Derivation of each line-item column from the joined star row. The same
# expressions (same text, valid in Spark SQL and DuckDB) build the oracle CTE.
HELPERS = [
    ("disc_pct", "cast(round(l_discount * 100) as int) * 5"),
    ("ext_c", "cast(round(l_extendedprice * 100) as bigint)"),
    ("cost_pct", "55 + l_partkey % 41"),
]
HELPERS_2 = [
    ("s4", "ext_c * (100 - disc_pct)"),
    ("p4", "ext_c * (100 - disc_pct - cost_pct)"),
]
LINE_ITEM_EXPRS = [
    ("row_id", "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"),
    ("order_id", "cast(l_orderkey as string)"),
    ("order_date", "cast(o_orderdate as date)"),
    ("ship_date", "cast(l_shipdate as date)"),
    ("ship_mode", "o_orderpriority"),
    ("customer_id", "cast(c_custkey as string)"),
    ("customer_name", "c_name"),
    ("segment", "c_mktsegment"),
    ("country", "'N/A'"),
    ("city", "s_name"),
    ("state", "n_name"),
    ("postal_code", "lpad(cast(l_suppkey as string), 5, '0')"),
    ("region", "r_name"),
    ("product_id", "cast(l_partkey as string)"),
    ("category", "p_type"),
    ("sub_category", "p_brand"),
    ("product_name", "p_name"),
    ("sales", "cast(cast(s4 - s4 % 100 as decimal(18,0)) * cast(0.0001 as decimal(5,4)) as decimal(10,2))"),
    ("quantity", "cast(l_quantity as int)"),
    ("discount", "cast(cast(disc_pct as decimal(6,0)) * cast(0.01 as decimal(3,2)) as decimal(4,2))"),
    ("profit", "cast(cast(p4 - p4 % 100 as decimal(18,0)) * cast(0.0001 as decimal(5,4)) as decimal(10,2))"),
]

LINE_ITEM = dict(LINE_ITEM_EXPRS)


def read_star(spark: SparkSession, sf_dir: str, declared: bool = True) -> dict[str, DataFrame]:
    """The star tables of ``sf_dir`` (declared schemas unless ``declared=False``)."""
    out = {}
    for t in STAR_TABLES:
        r = spark.read.schema(STAR_SCHEMAS[t]) if declared else spark.read
        out[t] = r.parquet(os.path.join(sf_dir, f"{t}.parquet"))
    return out


# Below this many lines a fact table may sit in fewer splits than there are cores (the test
# tables hold it in one row group) and is dealt out once more before the joins.
NARROW_ROWS = 5_000_000


# Upper estimates of a row's bytes in memory, of the columns that are joined.
ROW_BYTES = {"customer": 120, "supplier": 160, "part": 200, "orders": 240}
COUNTED = ("lineitem", "orders", "customer", "part", "supplier")


def star_counts(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """Row counts of the fact and the growing dimensions, in one metadata-only job."""
    t = read_star(spark, sf_dir)
    return row_counts({k: t[k] for k in COUNTED})


def line_items_from_star(
    spark: SparkSession, sf_dir: str, counts: dict[str, int] | None = None,
    clustered: Callable[[DataFrame, list[str]], DataFrame] | None = None,
) -> DataFrame:
    """Lazy line-item DataFrame over the star tables in ``sf_dir``.

    ``counts`` (from ``star_counts``) proves the dimension sizes for the
    broadcast decisions; it is computed here when not given. ``clustered`` deals out the
    narrow lines by the columns named to it (order date and line key) and rows come sorted by order
    date and order within its partitions.
    """
    t = read_star(spark, sf_dir)
    geo = (
        t["nation"].select("n_nationkey", "n_name", "n_regionkey")
        .join(F.broadcast(t["region"].select("r_regionkey", "r_name")),
              F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "n_name", "r_name")
    )
    dims = {
        "customer": t["customer"].select("c_custkey", "c_name", "c_mktsegment"),
        "supplier": t["supplier"].select("s_suppkey", "s_name", "s_nationkey")
        .join(F.broadcast(geo), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", "s_name", "n_name", "r_name"),
        "part": t["part"].select("p_partkey", "p_name", "p_brand", "p_type"),
    }
    on = {
        "customer": F.col("o_custkey") == F.col("c_custkey"),
        "part": F.col("l_partkey") == F.col("p_partkey"),
        "supplier": F.col("l_suppkey") == F.col("s_suppkey"),
    }
    # One metadata-only job proves the size of every growing dimension.
    n = counts if counts is not None else row_counts({k: t[k] for k in COUNTED})
    sizes = {k: n[k] * w for k, w in ROW_BYTES.items()}
    small = within_budget(sizes)
    if not set(dims) <= small:  # by the estimates; the texts' lengths say more, at the cost of reading the dimensions
        small = within_budget(sizes | row_bytes(dims))
    # dates and whole numbers of cents, percent and pieces take a fraction of the doubles' and timestamps' shuffle
    orders = t["orders"].select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority")
    if "customer" not in small:
        orders = orders.join(dims["customer"], on["customer"])
    if "orders" in small:
        orders = F.broadcast(orders)  # N:1 join: at most one row per order
    li = t["lineitem"].select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        *[F.expr(LINE_ITEM[c]).alias(l) for c, l in (("quantity", "l_quantity"), ("ship_date", "l_shipdate"))],
        *[F.expr(e).alias(name) for name, e in HELPERS if name != "cost_pct"],
    )
    if n["lineitem"] < NARROW_ROWS:
        li = li.hint("rebalance")
    li = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    for d in ("supplier", "part"):  # after orders: their texts go through fewer shuffles
        if d not in small:
            li = li.join(dims[d], on[d])
    if clustered is not None:
        li = clustered(li, ["o_orderdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    for d in ("customer", "part", "supplier"):
        if d in small:
            li = li.join(F.broadcast(dims[d]), on[d])
    if clustered is not None:
        li = li.sortWithinPartitions("o_orderdate", "l_orderkey")  # after the joins: Spark drops a sort below one
    for name, e in [h for h in HELPERS if h[0] == "cost_pct"] + HELPERS_2:
        li = li.withColumn(name, F.expr(e))
    return li.select(*[F.expr(e).alias(n) for n, e in LINE_ITEM_EXPRS])
