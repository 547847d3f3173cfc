"""Semantics on hand-made frames: rounding, NULLs, tiers, windows, NTILE."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginscope.functions import margin_pct, mean, pct, tier_expr
from marginscope.operators import ranking, trends
from marginscope.operators.rollup import margin_rollup

D = Decimal


def _frame(spark, rows, schema="g string, sales decimal(10,2), profit decimal(10,2), discount decimal(4,2)"):
    return spark.createDataFrame(rows, schema)


def test_mean_has_no_double_rounding(spark):
    # 1,000 lines at 0.01 among 200,001: the mean is 0.0000499997..., so 0.0000 at 4 digits.
    df = spark.range(200001).select(
        F.when(F.col("id") < 1000, F.lit(D("0.01"))).otherwise(F.lit(D("0.00"))).cast("decimal(4,2)").alias("d"))
    assert df.agg(mean("d", 4).alias("m")).first().m == 0.0
    naive = df.agg(F.round(F.avg("d"), 4).alias("m")).first().m
    assert float(naive) == 0.0001  # what a plain AVG on DECIMAL(4,2) gives


def test_half_away_from_zero(spark):
    df = _frame(spark, [("a", D("8.00"), D("0.01"), D("0")), ("b", D("8.00"), D("-0.01"), D("0"))])
    out = {r.g: r.m for r in df.groupBy("g").agg(margin_pct().alias("m")).collect()}
    assert out == {"a": 0.13, "b": -0.13}


def test_zero_sales_margin_is_null(spark):
    df = _frame(spark, [("z", D("0.00"), D("5.00"), D("0")), ("z", D("0.00"), D("-1.00"), D("0"))])
    r = margin_rollup(df, ["g"]).first()
    assert r.profit_margin_pct is None and r.total_profit == 4.0


def test_pct_null_denominator(spark):
    r = spark.range(1).select(pct(F.lit(D("1")), F.lit(None).cast("decimal(10,2)")).alias("p")).first()
    assert r.p is None


@pytest.mark.parametrize("d,label", [
    ("0", "0%"), ("0.01", "1-20%"), ("0.20", "1-20%"), ("0.21", "21-40%"),
    ("0.40", "21-40%"), ("0.41", "40%+"), ("1.00", "40%+"), (None, "40%+"),
])
def test_tier_bounds(spark, d, label):
    df = spark.createDataFrame([(None if d is None else D(d),)], "discount decimal(4,2)")
    assert df.select(tier_expr().alias("t")).first().t == label


def test_lag_uses_previous_existing_month(spark):
    s = spark.createDataFrame(
        [(date(2020, 1, 1), D("100.00")), (date(2020, 3, 1), D("150.00")), (date(2020, 4, 1), D("0.00")),
         (date(2020, 5, 1), D("10.00"))],
        "month date, total_sales decimal(20,2)")
    rows = trends.period_growth(s).collect()
    assert [r.prev_month_sales for r in rows] == [None, 100.0, 150.0, 0.0]
    assert [r.mom_growth_pct for r in rows] == [None, 50.0, -100.0, None]


def test_moving_average_and_running_total(spark):
    s = spark.createDataFrame(
        [(date(2020, m, 1), D(v)) for m, v in [(1, "1.00"), (2, "2.00"), (3, "4.00"), (4, "0.01")]],
        "month date, total_sales decimal(20,2)")
    mv = [r.three_month_moving_avg for r in trends.moving_average(s).collect()]
    assert mv == [1.0, 1.5, 2.33, 2.0]
    rt = [r.running_total_sales for r in trends.running_total(s, value="total_sales").collect()]
    assert rt == [1.0, 3.0, 7.0, 7.01]


def test_rank_ties_and_gaps(spark):
    df = spark.createDataFrame(
        [("R", "a", D("5.00")), ("R", "b", D("5.00")), ("R", "c", D("1.00")), ("S", "a", D("2.00"))],
        "region string, item string, profit decimal(10,2)")
    rows = ranking.rank_within(df, "region", "item", rank_name="rk").collect()
    assert [(r.region, r.item, r.rk) for r in rows] == [("R", "a", 1), ("R", "b", 1), ("R", "c", 3), ("S", "a", 1)]
    top1 = ranking.rank_within(df, "region", "item", n=1, rank_name="rk").collect()
    assert len(top1) == 3  # ties at rank 1 are all kept


@pytest.mark.parametrize("n", [1, 5, 7, 23, 100, 1500])
@pytest.mark.parametrize("k", [10, 7])
def test_distributed_ntile_equals_ntile(spark, n, k):
    df = spark.range(n).select(
        (F.col("id") * 7919 % 97).cast("decimal(20,2)").alias("v"),
        F.format_string("c%05d", F.col("id")).alias("name"),
    ).repartition(6)
    order = [F.col("v").desc(), F.col("name").asc()]
    got = {r.name: r.b for r in ranking.ntile_distributed(df, k, order, name="b").collect()}
    ref = {r.name: r.b for r in df.select("name", F.ntile(k).over(Window.orderBy(*order)).alias("b")).collect()}
    assert got == ref


def test_ntile_formula_matches_definition():
    def ref(n, k):
        q, r = divmod(n, k)
        out = []
        for b in range(1, k + 1):
            out += [b] * (q + (1 if b <= r else 0))
        return out

    def formula(rn, n, k):
        q, r = divmod(n, k)
        big = r * (q + 1)
        return (rn - 1) // (q + 1) + 1 if rn <= big else r + (rn - big - 1) // q + 1

    for n in [1, 2, 9, 10, 11, 99, 1000, 1003]:
        for k in [1, 3, 7, 10]:
            assert [formula(i, n, k) for i in range(1, n + 1)] == ref(n, k)[:n]


def test_month_bucket_is_a_date(spark):
    df = spark.createDataFrame([(date(2020, 2, 29), D("1.00"), D("0.10"))], "order_date date, sales decimal(10,2), profit decimal(10,2)")
    out = trends.period_rollup(df)
    assert isinstance(out.schema["month"].dataType, T.DateType)
    assert out.first().month == date(2020, 2, 1)


def test_month_name_is_english(spark):
    df = spark.createDataFrame([(date(2020, m, 1), D("1.00"), D("0.10")) for m in (1, 9)],
                               "order_date date, sales decimal(10,2), profit decimal(10,2)")
    assert {r.month_name for r in trends.seasonality(df).collect()} == {"January", "September"}


def test_distributed_ntile_splits_a_hot_value(spark):
    # a third of the rows share one sales value: the range bounds split it by name
    n = 3000
    df = spark.range(n).select(
        F.when(F.col("id") < n // 3, F.lit(7)).otherwise(F.col("id")).cast("decimal(20,2)").alias("v"),
        F.format_string("c%05d", F.col("id")).alias("name"),
    )
    order = [F.col("v").desc(), F.col("name").asc()]
    parts = (df.repartitionByRange(8, *order).groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert max(r["count"] for r in parts) < n // 4
    got = {r.name: r.b for r in ranking.ntile_distributed(df, 10, order, name="b").collect()}
    ref = {r.name: r.b for r in df.select("name", F.ntile(10).over(Window.orderBy(*order)).alias("b")).collect()}
    assert got == ref


@pytest.mark.parametrize("ascending", [False, True])
def test_distributed_rank_equals_rank(spark, ascending):
    # one hot group holding a third of the items, many value ties, a NULL group and NULL values
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 97 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("grp"),
        F.format_string("i%05d", F.col("id")).alias("item"),
        F.when(F.col("id") % 50 == 7, F.lit(None)).otherwise((F.col("id") * 7919 % 41)).cast("decimal(20,2)").alias("v"),
    ).repartition(5)
    got = ranking.rank_distributed(df, ["grp"], "v", ascending, "rk")
    o = F.col("v").asc_nulls_last() if ascending else F.col("v").desc_nulls_first()
    ref = df.withColumn("rk", F.rank().over(Window.partitionBy("grp").orderBy(o)))
    g = {r.item: (r.grp, r.v, r.rk) for r in got.select("grp", "item", "v", "rk").collect()}
    e = {r.item: (r.grp, r.v, r.rk) for r in ref.select("grp", "item", "v", "rk").collect()}
    assert len(g) == 3000 and g == e


def test_rank_within_distributed_flag(li001):
    a = ranking.rank_within(li001, "region", "customer_name", rank_name="r").collect()
    b = ranking.rank_within(li001, "region", "customer_name", rank_name="r", distributed=True).collect()
    assert a == b


def test_null_order_follows_source_sql(spark):
    # Ascending puts NULLs last, descending puts them first
    df = spark.createDataFrame(
        [("a", D("1.00"), D("1.00"), D("0")), ("b", D("2.00"), None, D("0")), ("c", D("3.00"), D("-1.00"), D("0"))],
        "g string, sales decimal(10,2), profit decimal(10,2), discount decimal(4,2)")
    asc = [r.g for r in margin_rollup(df, ["g"], order=["total_profit"]).collect()]
    assert asc == ["c", "a", "b"]
    desc = [r.g for r in margin_rollup(df, ["g"], order=[F.col("total_profit").desc_nulls_first()]).collect()]
    assert desc == ["b", "a", "c"]


def test_top_k_ties_broken_by_name(spark):
    # Equal profits -> the alphabetically first names win, every time
    from marginscope.operators.customers import top_customers

    rows = [(f"C{i:02d}", f"O{i}", D("10.00"), D("5.00"), D("0.10")) for i in range(12)]
    df = spark.createDataFrame(rows, "customer_name string, order_id string, sales decimal(10,2), "
                                     "profit decimal(10,2), discount decimal(4,2)").repartition(4)
    got = [r.customer_name for r in top_customers(df, 3).collect()]
    assert got == ["C00", "C01", "C02"]


def test_distributed_windows_on_empty_input(spark):
    df = spark.createDataFrame([], "grp string, key string, v decimal(20,2)")
    assert ranking.ntile_distributed(df, 10, [F.col("v").desc(), F.col("key")], name="b").count() == 0
    assert ranking.rank_distributed(df, ["grp"], "v").count() == 0
