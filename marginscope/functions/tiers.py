"""Discount tiers and the profit flag as plain CASE expressions."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tier labels, the tier bounds (upper bound of each tier,
# inclusive, on the discount proportion) and the profit flag labels.
TIER_LABELS = ("0%", "1-20%", "21-40%", "40%+")
TIER_BOUNDS = ("0", "0.2", "0.4")
LOSS_LABEL = "Loss"
PROFIT_LABEL = "Profit"
DEFAULT_THRESHOLD = "0.2"


def dec(x) -> Column:
    """Exact decimal literal (never a double) for comparisons with DECIMAL(4,2)."""
    return F.lit(Decimal(str(x)))


def tier_expr(
    discount: str | Column = "discount",
    bounds: Sequence = TIER_BOUNDS,
    labels: Sequence[str] = TIER_LABELS,
) -> Column:
    """First bound is an equality (no discount), the others are ``<=`` cut points."""
    if len(labels) != len(bounds) + 1:
        raise ValueError("need exactly one more label than bounds")
    d = F.col(discount) if isinstance(discount, str) else discount
    expr = F.when(d == dec(bounds[0]), F.lit(labels[0]))
    for b, label in zip(bounds[1:], labels[1:-1]):
        expr = expr.when(d <= dec(b), F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))


def profit_flag(profit: str | Column = "profit") -> Column:
    p = F.col(profit) if isinstance(profit, str) else profit
    return F.when(p < 0, F.lit(LOSS_LABEL)).otherwise(F.lit(PROFIT_LABEL))
