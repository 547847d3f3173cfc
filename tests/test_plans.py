"""Physical-plan properties that matter at scale."""

import pytest

import __spark_entry__ as E
from conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df):
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_threshold_filter_reaches_scan(spark):
    txt = _formatted(E.queries()["high_discount_impact"](spark, SF001))
    assert "PushedFilters: [IsNotNull(discount), GreaterThan(discount,0.20)]" in txt


def test_scan_reads_only_needed_columns(spark, li001):
    from marginscope.operators.rollup import margin_rollup

    txt = _formatted(margin_rollup(li001, ["state"], order=["total_profit"]))
    assert "ReadSchema: struct<state:string,sales:decimal(10,2),profit:decimal(10,2)>" in txt
    # the registered report reads the same columns of its cuboid's folder instead
    txt = _formatted(E.queries()["by_state"](spark, SF001))
    assert "ReadSchema: struct<state:string,_s:decimal(20,2),_p:decimal(20,2)>" in txt and "/line_items/" not in txt
    assert "PartitionFilters: [isnotnull(cuboid" in txt


def test_top_n_per_group_is_limited_before_shuffle(spark):
    txt = _formatted(E.queries()["top5_customers_in_region"](spark, SF001))
    assert "WindowGroupLimit" in txt


def test_top_customers_is_take_ordered(spark):
    txt = _formatted(E.queries()["top_customers"](spark, SF001))
    assert "TakeOrderedAndProject" in txt


@pytest.mark.parametrize("name", ["thin_margin_accounts", "flagged_account_profile"])
def test_deciles_not_single_partition_over_customers(spark, name):
    txt = _formatted(E.queries()[name](spark, SF001))
    # no built-in NTILE (a window over all customers in one task) ...
    assert "ntile(" not in txt.lower()
    # ... but the checkpointed, range-partitioned customer rows
    assert "Scan ExistingRDD" in txt


@pytest.mark.parametrize("name", ["headline", "by_region", "discount_tiers", "threshold_split"])
def test_partial_aggregation(spark, name):
    txt = _formatted(E.queries()[name](spark, SF001))
    assert "partial_" in txt


def test_named_accounts_in_list_pushed(spark, li001):
    from marginscope.operators.customers import account_profile
    from marginscope.plans.params import NAMED_ACCOUNTS

    # over the lines the IN list reaches the parquet scan ...
    assert "In(customer_name" in _formatted(account_profile(li001, NAMED_ACCOUNTS))
    # ... the registered report reads the (much smaller) customer aggregate instead, with the same pushdown
    txt = _formatted(E.queries()["named_account_profile"](spark, SF001))
    assert "customer_cube" in txt and "/line_items/" not in txt and "In(customer_name" in txt


@pytest.mark.parametrize("name", ["top5_customers_in_region", "multi_region_accounts", "customer_by_region",
                                  "flagged_account_profile"])
def test_customer_reports_read_the_customer_aggregate(spark, name):
    txt = _formatted(E.queries()[name](spark, SF001))
    assert "customer_cube" in txt and "/line_items/" not in txt


@pytest.mark.parametrize("name", ["headline", "by_segment", "top_customers", "top_customers_by_profit"])
def test_distinct_order_reports_read_the_order_aggregate(spark, name):
    txt = _formatted(E.queries()[name](spark, SF001))
    assert "order_aggregate" in txt and "/line_items/" not in txt


def _exchanges(df):
    df.collect()
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n") if "Exchange hash" in line]


def test_distinct_order_reports_do_not_shuffle_orders(spark):
    import __spark_entry__ as E

    for name in ("headline", "by_segment", "top_customers", "top_customers_by_profit"):
        shuffles = _exchanges(E.queries()[name](spark, "/root/testdata/sf0.001"))
        assert not any("order_id" in x for x in shuffles), name


def test_distinct_orders_with_orders_of_several_customers(spark, li001):
    from pyspark.sql import functions as F

    from marginscope.operators.rollup import margin_rollup, order_aggregate

    odd = li001.withColumn("order_id", F.when(F.col("quantity") % 5 == 0, None).otherwise((F.col("quantity") % 9).cast("string")))
    orders = order_aggregate(odd)
    measures = ["total_orders", "line_items", "total_sales"]
    for dims in ([], ["segment"], ["customer_name"], ["customer_name", "segment"]):
        want = sorted(margin_rollup(odd, dims, measures).collect())
        assert sorted(margin_rollup(odd, dims, measures, orders=orders).collect()) == want


def test_profile_and_gate_share_one_key_aggregate(spark):
    import __spark_entry__ as E

    for name in ("load_profile", "quality_report"):
        shuffles = _exchanges(E.queries()[name](spark, "/root/testdata/sf0.001"))
        assert not any("row_id" in x for x in shuffles), name


def test_thresholds_have_names_of_their_own():
    from marginscope.operators.discount import _pct_label

    assert [_pct_label(t) for t in ("0.2", "0.12", "0.125", "0")] == ["20pct", "12pct", "12_5pct", "0pct"]
