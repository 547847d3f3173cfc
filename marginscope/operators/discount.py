"""Discount analysis.

Reports that the source system expresses as two scans or scalar
subqueries (loss concentration, recoverable profit, hidden losses) are
written here as one scan with conditional aggregates. All but the detail
rows take line items or the cells of a cuboid that keeps their dimensions.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import (
    DEFAULT_THRESHOLD,
    TIER_BOUNDS,
    TIER_LABELS,
    dec,
    pct,
    share_pct,
    tier_expr,
)
from ..functions.additive import Additive
from .rollup import margin_rollup

TIER_MEASURES = ("num_orders", "total_sales", "total_profit", "avg_profit_per_order", "profit_margin_pct")


def _pct_label(t) -> str:
    """20pct, 12_5pct: different thresholds have different names."""
    pct = (Decimal(str(t)) * 100).normalize()
    return f"{pct:f}".replace(".", "_") + "pct"


def with_discount_tier(
    df: DataFrame, bounds: Sequence = TIER_BOUNDS, labels: Sequence[str] = TIER_LABELS, name: str = "discount_tier"
) -> DataFrame:
    return df.withColumn(name, tier_expr("discount", bounds, labels))


def discount_tiers(
    df: DataFrame,
    bounds: Sequence = TIER_BOUNDS,
    labels: Sequence[str] = TIER_LABELS,
    name: str = "discount_tier",
    measures: Sequence[str] = TIER_MEASURES,
) -> DataFrame:
    """Rollup by discount tier, ordered by label (labels sort in binary order)."""
    return margin_rollup(with_discount_tier(df, bounds, labels, name), [name], measures, order=[name])


def by_discount_level(df: DataFrame) -> DataFrame:
    out = margin_rollup(df, ["discount"], TIER_MEASURES, order=["discount"])
    return out.withColumn("discount", F.col("discount").cast("double"))


def tier_sign_rollup(df: DataFrame, bounds: Sequence = TIER_BOUNDS, labels: Sequence[str] = TIER_LABELS) -> DataFrame:
    """Second-level rollup of the tiers by the sign of their profit.

    Tiers are few (one row per label), so the share over all tiers is an
    un-partitioned window over at most two rows.
    """
    of = Additive(df)
    tiers = (
        with_discount_tier(df, bounds, labels)
        .groupBy("discount_tier")
        .agg(of.count().alias("n"), of.total("profit").alias("p"))
    )
    side = F.when(F.col("p") >= 0, F.lit("profitable")).otherwise(F.lit("loss-making"))
    signs = tiers.groupBy(side.alias("tier_result")).agg(
        F.count(F.lit(1)).alias("num_tiers"),
        F.sum("n").alias("line_items"),
        F.sum("p").alias("p"),
    )
    total = F.sum("line_items").over(Window.partitionBy())
    return signs.select(
        "tier_result",
        "num_tiers",
        "line_items",
        F.col("p").cast("double").alias("total_profit"),
        share_pct(F.col("line_items"), total, 2).alias("pct_of_line_items"),
    ).orderBy("tier_result")


def above_threshold(
    df: DataFrame,
    threshold=DEFAULT_THRESHOLD,
    dims: Sequence[str] = ("category", "sub_category"),
    measures: Sequence = (),
    order: Sequence | None = None,
) -> DataFrame:
    """Rollup of the lines discounted above ``threshold`` (the filter reaches the scan)."""
    return margin_rollup(df.where(F.col("discount") > dec(threshold)), dims, measures, order)


def high_discount_impact(df: DataFrame, threshold=DEFAULT_THRESHOLD) -> DataFrame:
    of = Additive(df)
    return above_threshold(
        df, threshold, ["category", "sub_category"],
        [
            of.count().alias("num_high_discount_orders"),
            of.total("sales").cast("double").alias("total_sales"),
            of.total("profit").cast("double").alias("total_profit_impact"),
            of.mean("discount", 4).alias("avg_discount"),
        ],
        order=[F.col("total_profit_impact").asc_nulls_last()],
    )


def high_discount_detail(df: DataFrame, threshold=DEFAULT_THRESHOLD) -> DataFrame:
    of = Additive(df)
    out = above_threshold(
        df, threshold, ["category", "sub_category", "discount"],
        [
            of.count().alias("num_high_discount_orders"),
            of.total("profit").cast("double").alias("total_profit_impact"),
        ],
        order=[F.col("total_profit_impact").asc_nulls_last()],
    )
    return out.select(
        "category", "sub_category", "num_high_discount_orders", "total_profit_impact",
        F.col("discount").cast("double").alias("discount"),
    )


def threshold_split(df: DataFrame, threshold=DEFAULT_THRESHOLD, dims: Sequence[str] = ("sub_category",)) -> DataFrame:
    """Profit and line counts at-or-below vs above ``threshold`` per group, in one pass.

    Adds the overall profit, the share of lines above the threshold and a
    ``structural_loss`` flag (loses money with no line above the threshold).
    Lines with a NULL discount count on neither side but in the overall.
    """
    t = dec(threshold)
    lab = _pct_label(threshold)
    below, above = F.col("discount") <= t, F.col("discount") > t
    zero, of = F.lit(Decimal("0.00")), Additive(df)
    out = df.groupBy(*dims).agg(
        of.total("profit", below, zero).alias("b"),
        of.total("profit", above, zero).alias("a"),
        of.count_if(below).alias(f"orders_at_or_below_{lab}"),
        of.count_if(above).alias(f"orders_above_{lab}"),
        of.total("profit").alias("t"),
        of.count().alias("n"),
    )
    return out.select(
        *dims,
        F.col("b").cast("double").alias(f"profit_at_or_below_{lab}"),
        F.col("a").cast("double").alias(f"profit_above_{lab}"),
        f"orders_at_or_below_{lab}",
        f"orders_above_{lab}",
        F.col("t").cast("double").alias("total_profit"),
        share_pct(F.col(f"orders_above_{lab}"), F.col("n"), 2).alias(f"pct_lines_above_{lab}"),
        ((F.col(f"orders_above_{lab}") == 0) & (F.col("t") < 0)).alias("structural_loss"),
    ).orderBy(F.col(f"profit_above_{lab}").asc_nulls_last(), *dims)


def structural_losses(df: DataFrame, threshold=DEFAULT_THRESHOLD, dims: Sequence[str] = ("sub_category",)) -> DataFrame:
    """Groups that lose money with no line above the threshold."""
    return threshold_split(df, threshold, dims).where("structural_loss").drop("structural_loss")


def recoverable_profit(df: DataFrame, threshold=DEFAULT_THRESHOLD) -> DataFrame:
    """Loss above the threshold and the profit if it were eliminated (one pass)."""
    t = dec(threshold)
    lab = _pct_label(threshold)
    above, of = F.col("discount") > t, Additive(df)
    agg = df.agg(
        of.total("profit", above).alias("loss"),
        of.count_if(above).alias("orders_affected"),
        of.count().alias("n"),
        of.total("profit").alias("total"),
    )
    return agg.select(
        F.col("loss").cast("double").alias(f"loss_above_{lab}_discount"),
        "orders_affected",
        share_pct(F.col("orders_affected"), F.col("n"), 2).alias("pct_of_order_volume"),
        F.col("total").cast("double").alias("current_total_profit"),
        (F.col("total") - F.col("loss")).cast("double").alias("profit_if_losses_eliminated"),
        pct(F.abs(F.col("loss")), F.col("total"), 2).alias("loss_as_pct_of_total_profit"),
    )


def loss_concentration(df: DataFrame) -> DataFrame:
    """Loss-making lines: count, share of all lines, total loss, their average discount."""
    of = Additive(df)
    loss = of.loss()
    agg = df.agg(
        of.count_if(loss).alias("loss_making_line_items"),
        of.count().alias("n"),
        of.total("profit", loss).alias("total_loss"),
        of.mean("discount", 4, loss).alias("avg_discount_on_losses"),
    )
    return agg.select(
        "loss_making_line_items",
        share_pct(F.col("loss_making_line_items"), F.col("n"), 2).alias("pct_of_all_line_items"),
        F.col("total_loss").cast("double").alias("total_loss"),
        "avg_discount_on_losses",
    )


def hidden_losses(df: DataFrame, dim: str = "sub_category") -> DataFrame:
    """Profitable groups that still contain loss-making lines, by loss share of profit."""
    of = Additive(df)
    loss = of.loss()
    g = df.groupBy(dim).agg(
        of.total("profit").alias("tp"),
        of.count_if(loss).alias("loss_orders"),
        of.total("profit", loss).alias("la"),
    )
    return (
        g.where((F.col("tp") > 0) & (F.col("loss_orders") > 0))
        .select(
            dim,
            F.col("tp").cast("double").alias("total_profit"),
            "loss_orders",
            F.col("la").cast("double").alias("loss_amount"),
            pct(F.abs(F.col("la")), F.col("tp"), 1).alias("loss_as_pct_of_profit"),
        )
        .orderBy(F.col("loss_as_pct_of_profit").desc_nulls_first(), dim)
    )


def discount_trend(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares trend of line profit on discount (the scatter's trend line).

    Five exact decimal sums over the lines where both are present, so the result
    does not depend on the order in which tasks are merged; the ratios are
    taken from them at last. ``points`` counts all lines.
    """
    of = Additive(df)
    sums = [of.count().alias("points"), *of.pairs()]
    g = df.groupBy(*by).agg(*sums) if by else df.agg(*sums)
    n, sx, sy, sxy, sxx, syy = (F.col(c).cast("double") for c in ("_bn", "_bx", "_by", "_bxy", "_bxx", "_byy"))
    cov, vx, vy = sxy - sx * sy / F.nullif(n, F.lit(0.0)), sxx - sx * sx / F.nullif(n, F.lit(0.0)), syy - sy * sy / F.nullif(n, F.lit(0.0))
    slope = cov / F.nullif(vx, F.lit(0.0))
    return g.select(
        *by,
        "points",
        F.round(slope, 2).alias("slope"),
        F.round((sy - slope * sx) / F.nullif(n, F.lit(0.0)), 2).alias("intercept"),
        F.round(F.when(vy == 0, F.when(vx != 0, F.lit(1.0))).otherwise(cov * cov / F.nullif(vx * vy, F.lit(0.0))), 6).alias("r2"),
        F.round(cov / F.nullif(F.sqrt(vx * vy), F.lit(0.0)), 6).alias("correlation"),
    )


__all__ = [
    "with_discount_tier", "discount_tiers", "by_discount_level", "tier_sign_rollup", "above_threshold",
    "high_discount_impact", "high_discount_detail", "threshold_split", "structural_losses",
    "recoverable_profit", "loss_concentration", "hidden_losses", "discount_trend",
]
