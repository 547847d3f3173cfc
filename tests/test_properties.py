"""Property tests: the distributed NTILE / RANK equal Spark's window functions."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from marginscope.operators import ranking

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def _frame(spark, n, groups, distinct, parts, seed):
    return spark.range(n).select(
        F.when(F.col("id") % 11 == seed % 11, F.lit(None))
        .otherwise((F.col("id") * (seed + 3) % groups).cast("string")).alias("grp"),
        F.format_string("k%06d", F.col("id")).alias("key"),
        F.when(F.col("id") % 13 == seed % 13, F.lit(None))
        .otherwise((F.col("id") * 7919 + seed) % distinct).cast("decimal(20,2)").alias("v"),
    ).repartition(parts)


@SETTINGS
@given(n=st.integers(1, 700), k=st.integers(1, 12), distinct=st.integers(1, 50),
       parts=st.integers(1, 7), seed=st.integers(0, 1000))
def test_ntile_property(spark, n, k, distinct, parts, seed):
    df = _frame(spark, n, 3, distinct, parts, seed)
    order = [F.col("v").desc_nulls_first(), F.col("key").asc()]
    got = {r.key: r.b for r in ranking.ntile_distributed(df, k, order, name="b").collect()}
    ref = {r.key: r.b for r in df.select("key", F.ntile(k).over(Window.orderBy(*order)).alias("b")).collect()}
    assert got == ref


@SETTINGS
@given(n=st.integers(1, 700), groups=st.integers(1, 6), distinct=st.integers(1, 40),
       parts=st.integers(1, 7), seed=st.integers(0, 1000), ascending=st.booleans())
def test_rank_property(spark, n, groups, distinct, parts, seed, ascending):
    df = _frame(spark, n, groups, distinct, parts, seed)
    o = F.col("v").asc_nulls_last() if ascending else F.col("v").desc_nulls_first()
    got = {r.key: r.rk for r in ranking.rank_distributed(df, ["grp"], "v", ascending, "rk").collect()}
    ref = {r.key: r.rk for r in df.withColumn("rk", F.rank().over(Window.partitionBy("grp").orderBy(o))).collect()}
    assert got == ref


@SETTINGS
@given(rows=st.lists(
    st.tuples(st.integers(0, 3), st.integers(1, 10_000_000), st.integers(-5_000_000, 5_000_000), st.integers(0, 80)),
    min_size=1, max_size=300))
def test_exact_rounding_property(spark, rows):
    from decimal import ROUND_HALF_UP, Decimal

    from marginscope.functions import margin_pct, mean

    data = [(g, Decimal(s) / 100, Decimal(p) / 100, Decimal(d) / 100) for g, s, p, d in rows]
    df = spark.createDataFrame(data, "g int, sales decimal(10,2), profit decimal(10,2), discount decimal(4,2)")
    got = {r.g: (r.m, r.a) for r in df.groupBy("g").agg(margin_pct().alias("m"), mean("discount", 4).alias("a")).collect()}
    want = {}
    for g in {r[0] for r in data}:
        grp = [r for r in data if r[0] == g]
        s, p = sum(r[1] for r in grp), sum(r[2] for r in grp)
        m = float((p * 100 / s).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))
        a = float((sum(r[3] for r in grp) / len(grp)).quantize(Decimal("0.0001"), rounding=ROUND_HALF_UP))
        want[g] = (m, a)
    assert got == want
