"""Fixture adapter totals (FIXTURES.md section 5, sf0.001)."""

from decimal import Decimal

from pyspark.sql import functions as F

from marginscope.operators.discount import discount_tiers
from marginscope.sources.schema import LINE_ITEM_SCHEMA


def test_schema(li001):
    assert [(f.name, f.dataType) for f in li001.schema.fields] == [
        (f.name, f.dataType) for f in LINE_ITEM_SCHEMA.fields
    ]


def test_totals(li001):
    r = li001.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("k"),
        F.sum("sales").alias("s"), F.sum("profit").alias("p"), F.count_distinct("order_id").alias("o"),
    ).first()
    assert (r.n, r.k, r.o) == (6000, 5999, 1473)
    assert r.s == Decimal("236895147.15")
    assert r.p == Decimal("-70202.54")


def test_tiers_sf0001(li001):
    rows = {r.discount_tier: r for r in discount_tiers(li001).collect()}
    assert list(rows) == ["0%", "1-20%", "21-40%", "40%+"]
    t0 = rows["0%"]
    assert (t0.num_orders, t0.total_sales, t0.total_profit) == (290, 14885079.13, 3719109.99)
    assert (t0.avg_profit_per_order, t0.profit_margin_pct) == (12824.52, 24.99)
    t4 = rows["40%+"]
    assert (t4.num_orders, t4.total_profit, t4.avg_profit_per_order, t4.profit_margin_pct) == (
        895, -10394232.47, -11613.67, -41.0)


def test_materialized_equals_lazy(spark, li001):
    from marginscope.sources.table import line_items

    lazy = line_items(spark, "/root/testdata/sf0.001", materialize=False)
    assert lazy.exceptAll(li001).count() == 0
    assert li001.exceptAll(lazy).count() == 0


def test_declared_star_schemas_match_files(spark):
    from marginscope.sources.star import read_star

    declared = read_star(spark, "/root/testdata/sf0.001")
    inferred = read_star(spark, "/root/testdata/sf0.001", declared=False)
    for t in declared:
        assert declared[t].schema.simpleString() == inferred[t].schema.simpleString(), t


def test_partitioned_write_prunes_by_directory(spark, li001):
    import os
    import tempfile

    from pyspark.sql import functions as F

    from marginscope.sources.table import read_line_items, write_line_items

    out = os.path.join(tempfile.mkdtemp(prefix="run-part-", dir="/tmp"), "t")
    write_line_items(li001, out, partition_by=["order_year"])
    back = read_line_items(spark, out)
    assert back.count() == 6000 and "order_year" in back.columns
    assert sorted(os.listdir(out))[0].startswith("_SUCCESS") or any(n.startswith("order_year=") for n in os.listdir(out))
    one = back.where("order_year = 1997")
    assert "PartitionFilters: [isnotnull(order_year" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == li001.where(F.year("order_date") == 1997).count()


def test_write_sizes_files_by_rows(spark, li001, monkeypatch):
    import os
    import tempfile

    from marginscope.sources import table

    monkeypatch.setattr(table, "ROWS_PER_FILE", 500)  # 6,000 rows -> 12 ranges > 8 configured
    out = os.path.join(tempfile.mkdtemp(prefix="run-size-", dir="/tmp"), "t")
    table.write_line_items(li001, out, rows=6000)
    files = [f for f in os.listdir(out) if f.endswith(".parquet")]
    assert len(files) == 12
    assert table.read_line_items(spark, out).count() == 6000


def test_large_dimensions_take_the_shuffle_join_path(spark, li001, monkeypatch):
    from marginscope.operators import joins
    from marginscope.sources import star

    # pretend every growing dimension is over the broadcast bound; turn off Spark's own
    # size-based broadcast too, so the plan is the one a 100 TB run gets
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 5)  # below every dimension (10 suppliers at sf0.001)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        big = star.line_items_from_star(spark, "/root/testdata/sf0.001")
        plan = big._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 4  # orders-customer, lineitem-orders, -part, -supplier
        assert plan.count("BroadcastHashJoin") == 2  # nation and region: bounded by the spec
        assert big.exceptAll(li001).count() == 0 and li001.exceptAll(big).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_broadcasts_share_one_budget():
    from marginscope.operators.joins import within_budget

    sizes = {"a": 50, "b": 60, "c": 10, "d": 200}
    assert within_budget(sizes, 120) == {"a", "b", "c"}
    assert within_budget(sizes, 119) == {"a", "c"}
    assert within_budget(sizes, 9) == set()


def test_lost_lines_raise(spark, tmp_path, monkeypatch):
    import pytest

    from marginscope.sources import table

    for t in table.STAR_TABLES:
        df = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        (df.where("p_partkey % 7 <> 0") if t == "part" else df).write.parquet(f"{tmp_path}/{t}.parquet")
    with pytest.raises(ValueError, match="source lines became"):
        table.line_items(spark, str(tmp_path))


def test_changed_input_is_not_served_stale(spark, tmp_path):
    from marginscope.session import fingerprint

    spark.range(5).write.parquet(f"{tmp_path}/t.parquet")
    first = fingerprint(spark, [f"{tmp_path}/t.parquet"])
    assert first == fingerprint(spark, [f"{tmp_path}/t.parquet"])
    spark.range(6).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert first != fingerprint(spark, [f"{tmp_path}/t.parquet"])
    assert fingerprint(spark, ["/no/such/file"]) != fingerprint(spark, ["/no/such/file"])


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from marginscope.session import ensure_checkpoint_dir

    class Conf(dict):
        def get(self, k, d=None):
            return d

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="share"):
        ensure_checkpoint_dir(Session())
