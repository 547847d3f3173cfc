"""Counts and sums over line items, or over cells that hold them already.

A report that only counts and sums can run on the lines or on any cuboid of them
that keeps the report's dimensions (``operators.cuboids``). ``Additive`` gives the
aggregates for the frame at hand, with the same types and the same NULLs on both: sums of
cells are cast back to the width that a sum of the lines has, so that ratios
keep their precision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .money import pct

# Cell column -> aggregate of the lines. ``_b*`` and the products are over lines with both discount and profit.
_BOTH = lambda c: F.when(F.col("discount").isNotNull() & F.col("profit").isNotNull(), c)
CELLS = {
    "_n": lambda: F.count(F.lit(1)),
    "_s": lambda: F.sum("sales"),
    "_p": lambda: F.sum("profit"),
    "_pn": lambda: F.count("profit"),
    "_ds": lambda: F.sum("discount"),
    "_dn": lambda: F.count("discount"),
    "_t": lambda: F.sum(F.datediff("ship_date", "order_date").cast("decimal(10,0)")),
    "_tn": lambda: F.count(F.datediff("ship_date", "order_date")),
    "_bn": lambda: F.count(_BOTH(F.lit(1))),
    "_bx": lambda: F.sum(_BOTH(F.col("discount"))),
    "_by": lambda: F.sum(_BOTH(F.col("profit"))),
    "_bxy": lambda: F.sum(_BOTH(F.col("discount") * F.col("profit"))),
    "_bxx": lambda: F.sum(_BOTH(F.col("discount") * F.col("discount"))),
    "_byy": lambda: F.sum(_BOTH(F.col("profit") * F.col("profit"))),
}
# Value -> its cell columns: sum, number of values, and the width of a sum of lines.
_VALUES = {
    "sales": ("_s", None, "decimal(20,2)"),
    "profit": ("_p", "_pn", "decimal(20,2)"),
    "discount": ("_ds", "_dn", "decimal(14,2)"),
    "days_to_ship": ("_t", "_tn", "decimal(20,0)"),
}


def is_cells(df: DataFrame) -> bool:
    return "_n" in df.columns


class Additive:
    """Aggregates of ``df``, which holds line items or cells of a cuboid."""

    def __init__(self, df: DataFrame) -> None:
        self.cells = is_cells(df)

    def _value(self, name: str) -> Column:
        if self.cells:
            return F.col(_VALUES[name][0])
        return F.datediff("ship_date", "order_date").cast("decimal(10,0)") if name == "days_to_ship" else F.col(name)

    def loss(self) -> Column:
        """Whether a line loses money: on cells the dimension ``loss``."""
        return F.col("loss") if self.cells else F.col("profit") < 0

    def count(self) -> Column:
        return F.coalesce(F.sum("_n"), F.lit(0)) if self.cells else F.count(F.lit(1))

    def count_if(self, which: Column) -> Column:
        return F.coalesce(F.sum(F.when(which, F.col("_n"))), F.lit(0)) if self.cells else F.count_if(which)

    def total(self, name: str, which: Column | None = None, otherwise: Column | None = None) -> Column:
        """Sum of a value over the lines where ``which`` holds; the others count as ``otherwise``."""
        value = self._value(name)
        if which is not None:
            value = F.when(which, value) if otherwise is None else F.when(which, value).otherwise(otherwise)
        out = F.sum(value)
        return out.cast(_VALUES[name][2]) if self.cells else out

    def mean(self, name: str, digits: int, which: Column | None = None) -> Column:
        """Mean rounded once, from the exact sum and count."""
        if self.cells:
            number = F.col(_VALUES[name][1])
            n = F.sum(number if which is None else F.when(which, number))
        else:
            value = self._value(name)
            n = F.count(value if which is None else F.when(which, value))
        return F.round(self.total(name, which) / F.nullif(n.cast("decimal(20,0)"), F.lit(0)), digits).cast("double")

    def margin_pct(self) -> Column:
        return pct(self.total("profit"), self.total("sales"), 2)

    def pairs(self) -> list[Column]:
        """Sums for a line of profit on discount, over the lines that have both."""
        names = ("_bn", "_bx", "_by", "_bxy", "_bxx", "_byy")
        widths = ("long", "decimal(14,2)", "decimal(20,2)", "decimal(25,4)", "decimal(19,4)", "decimal(31,4)")
        if not self.cells:
            return [CELLS[c]().alias(c) for c in names]
        out = [F.sum(c).cast(w) for c, w in zip(names, widths)]
        return [(F.coalesce(c, F.lit(0)) if k == 0 else c).alias(n) for k, (n, c) in enumerate(zip(names, out))]
