"""Conservation laws: every split and rollup adds back up to the headline."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001


@pytest.fixture(scope="module")
def q(spark):
    cache = {}

    def get(name):
        if name not in cache:
            cache[name] = E.queries()[name](spark, SF001).collect()
        return cache[name]
    return get


def _close(a, b):
    return math.isclose(a, b, rel_tol=0, abs_tol=0.005)


def test_tiers_add_to_headline(q):
    h = q("headline")[0]
    tiers = q("discount_tiers")
    assert sum(r.num_orders for r in tiers) == h.total_line_items == 6000
    assert _close(sum(r.total_sales for r in tiers), h.total_sales)
    assert _close(sum(r.total_profit for r in tiers), h.total_profit)


def test_tier_signs_add_up(q):
    signs = q("tier_sign_rollup")
    assert sum(r.line_items for r in signs) == 6000
    assert sum(r.num_tiers for r in signs) == 4
    assert _close(sum(r.pct_of_line_items for r in signs), 100.0)


@pytest.mark.parametrize("name,dim", [("by_region", "region"), ("by_segment", "segment"),
                                      ("by_category", "category"), ("by_state", "state"),
                                      ("by_subcategory", "sub_category"), ("by_discount_level", "discount")])
def test_rollups_add_to_headline(q, name, dim):
    h = q("headline")[0]
    rows = q(name)
    assert _close(sum(r.total_profit for r in rows), h.total_profit)
    assert _close(sum(r.total_sales for r in rows), h.total_sales)


def test_threshold_split_halves(q):
    h = q("headline")[0]
    rec = q("recoverable_profit")[0]
    split = q("threshold_split")
    for r in split:
        assert _close(r.profit_at_or_below_20pct + r.profit_above_20pct, r.total_profit)
    assert sum(r.orders_above_20pct for r in split) == rec.orders_affected
    assert _close(sum(r.profit_above_20pct for r in split), rec.loss_above_20pct_discount)
    assert _close(rec.current_total_profit, h.total_profit)
    assert _close(rec.profit_if_losses_eliminated, h.total_profit - rec.loss_above_20pct_discount)
    assert (rec.orders_affected, rec.pct_of_order_volume) == (3367, 56.12)  # FIXTURES.md


def test_running_total_ends_at_total(q):
    h = q("headline")[0]
    series = q("monthly_running_total")
    assert len(series) == 80
    assert _close(series[-1].running_total_sales, h.total_sales)
    assert _close(sum(r.monthly_sales for r in series), h.total_sales)


def test_monthly_and_seasonal_add_up(q):
    h = q("headline")[0]
    assert _close(sum(r.monthly_profit for r in q("monthly_margin")), h.total_profit)
    assert _close(sum(r.total_profit for r in q("seasonality")), h.total_profit)


def test_loss_concentration_matches_fixture(q):
    r = q("loss_concentration")[0]
    assert (r.loss_making_line_items, r.pct_of_all_line_items, r.total_loss) == (2923, 48.72, -24208112.41)


def test_deciles_and_flags_match_fixture(q):
    assert len(q("thin_margin_accounts")) == 14
    assert len(q("flagged_account_profile")) == 70
    assert len(q("apparent_duplicates")) == 57
    assert len(q("hidden_losses")) == 13
    assert len(q("structural_losses")) == 89


def test_trend_matches_fixture(q):
    r = q("discount_trend")[0]
    assert (r.points, r.slope, r.r2) == (6000, -53143.31, 0.458391)


def test_named_profile_has_golden_shape(q):
    rows = q("named_account_profile")
    assert list(rows[0].asDict()) == ["customer_name", "segment", "region", "avg_discount_given",
                                      "num_orders", "total_profit"]
    assert len({r.customer_name for r in rows}) == 16
    assert [r.total_profit for r in rows] == sorted(r.total_profit for r in rows)


def test_customer_spans_regions(q):
    rows = q("customer_by_region")
    assert len(rows) == 5 and sum(r.num_orders for r in rows) == 21  # FIXTURES.md
    assert len(q("customer_detail")) == 21


def test_export_write_csv(spark):
    import os
    import tempfile

    from marginscope.operators.export import write_extract

    df = E.queries()["enriched_export"](spark, SF001)
    out = os.path.join(tempfile.mkdtemp(prefix="run-export-", dir="/tmp"), "extract")
    write_extract(df, out, fmt="csv")
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 6000
    assert back.columns[:5] == ["row_id", "order_id", "order_date", "ship_date", "days_to_ship"]
    assert back.where(F.col("profit_flag") == "Loss").count() == 2923
