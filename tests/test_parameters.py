"""Operators with parameters other than the registered defaults."""

from datetime import date

from pyspark.sql import functions as F

from marginscope.operators import customers as K
from marginscope.operators import discount as D
from marginscope.operators import export as X
from marginscope.operators import trends as T
from marginscope.operators.rollup import margin_rollup


def test_threshold_names_and_totals(li001):
    split = D.threshold_split(li001, "0.3").collect()
    assert "profit_above_30pct" in split[0].asDict()
    above = li001.where(F.col("discount") > 0.3).count()
    assert sum(r.orders_above_30pct for r in split) == above
    rec = D.recoverable_profit(li001, "0.3").first()
    assert rec.orders_affected == above


def test_custom_tier_bounds(li001):
    out = D.discount_tiers(li001, bounds=("0", "0.25"), labels=("none", "a", "deep")).collect()
    assert [r.discount_tier for r in out] == ["a", "deep", "none"]
    assert sum(r.num_orders for r in out) == 6000


def test_quarter_and_year_periods(li001):
    q = T.period_rollup(li001, period="quarter").collect()
    m = T.period_rollup(li001, period="month").collect()
    assert all(r.quarter.month in (1, 4, 7, 10) and r.quarter.day == 1 for r in q)
    assert round(sum(r.monthly_sales for r in q), 2) == round(sum(r.monthly_sales for r in m), 2)
    y = T.fulfilment(li001, "order_year", with_count=False).collect()
    assert [r.order_year for r in y] == sorted(r.order_year for r in y)


def test_moving_average_window_size(li001):
    s = T.period_sales(li001)
    one = T.moving_average(s, n=1).collect()
    assert all(r.three_month_moving_avg == r.total_sales for r in one)


def test_filters_each_alone(li001):
    total = li001.count()
    assert X.apply_filters(li001).count() == total
    r = X.apply_filters(li001, regions=["ASIA"]).count()
    assert r == li001.where("region = 'ASIA'").count() and 0 < r < total
    c = X.apply_filters(li001, categories=["PROMO"]).count()
    assert c == li001.where("category = 'PROMO'").count()
    s = X.apply_filters(li001, segments=["BUILDING"]).count()
    assert s == li001.where("segment = 'BUILDING'").count()
    d = X.apply_filters(li001, date_range=(date(1997, 1, 1), "1997-12-31")).count()
    assert d == li001.where("order_date between date'1997-01-01' and date'1997-12-31'").count()


def test_rollup_custom_measures(li001):
    out = margin_rollup(li001, ["segment"], ["line_items", F.max("sales").alias("largest_sale")]).collect()
    assert sum(r.line_items for r in out) == 6000 and all(r.largest_sale is not None for r in out)


def test_account_profile_by_frame_equals_by_list(spark, li001):
    names = ["Customer#000000003", "Customer#000000007"]
    by_list = K.account_profile(li001, names).collect()
    keys = spark.createDataFrame([(n,) for n in names], "customer_name string")
    by_frame = K.account_profile(li001, keys).collect()
    assert by_list == by_frame and len(by_list) > 0


def test_top_and_multi_region_parameters(li001):
    assert len(K.top_customers(li001, 3).collect()) == 3
    many = K.multi_region_accounts(li001, n=None, min_regions=4).collect()
    assert all(r.regions_active_in >= 4 for r in many)
    assert [r.total_profit for r in many] == sorted(r.total_profit for r in many)


def test_versus_company_gap(li001):
    prof = K.versus_company(K.account_profile(li001, ["Customer#000000001"], by=()), li001).first()
    assert round(prof.avg_discount_given - prof.company_avg_discount, 3) == prof.discount_vs_company


def test_date_filter_prunes_year_directories(spark, li001):
    import os
    import tempfile

    from marginscope.sources.table import read_line_items, write_line_items

    out = os.path.join(tempfile.mkdtemp(prefix="run-prune-", dir="/tmp"), "t")
    write_line_items(li001, out, partition_by=["order_year"])
    t = read_line_items(spark, out)
    f = X.apply_filters(t, date_range=("1997-03-01", "1998-02-28"))
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_year" in plan and "order_year#" in plan.split("PartitionFilters: [")[1][:200]
    assert f.count() == X.apply_filters(li001, date_range=("1997-03-01", "1998-02-28")).count()


def test_aggregate_paths_equal_line_paths(li001):
    from marginscope.operators.customers import customer_cube
    from marginscope.operators.rollup import order_aggregate

    orders, cube = order_aggregate(li001), customer_cube(li001)
    m = ["total_orders", "total_line_items", "total_sales", "total_profit", "profit_margin_pct", "avg_discount"]
    for dims in ([], ["segment"], ["customer_name"]):
        a = sorted(margin_rollup(li001, dims, m).collect())
        b = sorted(margin_rollup(li001, dims, m, orders=orders).collect())
        assert a == b, dims
    assert K.top_customers(li001, 7).collect() == K.top_customers(li001, 7, orders=orders).collect()
    assert sorted(K.customer_metrics(li001).collect()) == sorted(K.customer_metrics(li001, cube=cube).collect())
    assert K.multi_region_accounts(li001, n=None).collect() == K.multi_region_accounts(li001, n=None, cube=cube).collect()
    names = ["Customer#000000003", "Customer#000000007"]
    assert K.account_profile(li001, names).collect() == K.account_profile(li001, names, cube=cube).collect()
