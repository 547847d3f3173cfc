"""Column-expression helpers shared by every operator."""

from .money import count_rows, margin_pct, mean, pct, ratio, share_pct
from .tiers import (
    DEFAULT_THRESHOLD,
    LOSS_LABEL,
    PROFIT_LABEL,
    TIER_BOUNDS,
    TIER_LABELS,
    dec,
    profit_flag,
    tier_expr,
)

__all__ = [
    "count_rows", "margin_pct", "mean", "pct", "ratio", "share_pct",
    "DEFAULT_THRESHOLD", "LOSS_LABEL", "PROFIT_LABEL", "TIER_BOUNDS", "TIER_LABELS",
    "dec", "profit_flag", "tier_expr",
]
