"""A lattice of additive cuboids: many reports from one scan of the lines.

A cuboid holds, for every combination of its dimensions, the counts and exact sums of
``functions.additive``. A report over some dimensions can be answered from any cuboid that keeps them.
``choose`` picks cuboids greedily (Harinarayan, Rajaraman and Ullman, "Implementing Data Cubes
Efficiently"): the one that saves the reports most rows comes first, as long as
all together stay within a budget of rows. The chosen ones are summed in a single scan of
the lines (grouping sets, combined before the shuffle), written to one table with a folder each, and
each report reads the smallest folder that keeps its dimensions, or the lines if there is none.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.additive import CELLS

Dims = frozenset[str]

# Dimension -> expression over the lines, where it is not the column itself.
DERIVED = {
    "loss": lambda: F.col("profit") < 0,
    "order_date": lambda: F.trunc("order_date", "MM"),
}
#: Cuboids hold at most this share of the lines' number, and any number up to SMALL.
SHARE, SMALL = 0.1, 100_000
#: What one more grouping set costs the build, in passes over the lines.
GROUPING = 0.25


def _dimension(name: str):
    return (DERIVED[name]() if name in DERIVED else F.col(name)).alias(name)


def sizes(lines: DataFrame, wanted: Iterable[Dims]) -> tuple[int, dict[Dims, int]]:
    """Number of lines, and about how many cells each candidate has.

    Candidates are the wanted sets and the unions of two of them, which one cuboid may serve several
    reports with. Wanted sets are estimated by sketches in one scan of the dimensions; a
    union has at most the product of its two parts, and no more cells than there are lines.
    """
    sets = sorted(set(wanted), key=sorted)
    names = sorted(set().union(*sets)) if sets else []
    rows = lines.select(*[_dimension(d) for d in names])
    # nulls are values of their own
    text = {d: F.coalesce(F.col(d).cast("string"), F.lit("\0")) for d in names}
    one = {s: F.hll_sketch_estimate(F.hll_sketch_agg(F.concat_ws("\1", F.lit("="), *[text[d] for d in sorted(s)]))) for s in sets}
    number, *found = rows.agg(F.count(F.lit(1)), *one.values()).first()
    size = {s: min(n, number) for s, n in zip(sets, found)}
    for x, y in itertools.combinations(sets, 2):
        if x | y not in one:
            size[x | y] = min(number, size[x] * size[y], size.get(x | y, number))
    return number, size


def choose(lines: int, size: Mapping[Dims, int], wanted: Mapping[Dims, int], budget: int) -> list[Dims]:
    """Cuboids to keep: greedily the one that saves the reports most rows, within ``budget`` rows.

    ``wanted`` has the number of reports for each set of dimensions. A cuboid has to save more than its
    own making costs, GROUPING of a pass over the lines. Ties go to fewer dimensions, then to their names.
    """
    cost = {w: lines for w in wanted}
    chosen: list[Dims] = []
    left = budget
    while True:
        best, most = None, 0.0
        for s in sorted(size, key=lambda s: (len(s), sorted(s))):
            if s in chosen or size[s] > left:
                continue
            gain = sum(n * max(0, cost[w] - size[s]) for w, n in wanted.items() if w <= s) - GROUPING * lines
            if gain > most:
                best, most = s, gain
        if best is None:
            return chosen
        chosen.append(best)
        left -= size[best]
        for w in wanted:
            if w <= best:
                cost[w] = min(cost[w], size[best])


def build(lines: DataFrame, chosen: Iterable[Dims]) -> DataFrame:
    """The cells of all ``chosen`` cuboids in one frame, told apart by ``cuboid``, from one scan."""
    chosen = list(chosen)
    names = sorted(set().union(*chosen))
    measured = ["sales", "profit", "discount", "ship_date"]
    rows = lines.select(
        *[_dimension(d).alias(f"_k_{d}") for d in names], "order_date", *measured,
    )
    keys = [F.col(f"_k_{d}") for d in names]
    # an empty set beside others needs no keys; alone it is the global row
    grouped = rows.groupingSets([[F.col(f"_k_{d}") for d in names if d in s] for s in chosen], *keys) if names else rows.groupBy()
    cells = grouped.agg(
        *([F.grouping_id().alias("_id")] if names else [F.lit(0).alias("_id")]), *[make().alias(c) for c, make in CELLS.items()]
    )
    # grouping_id has a bit for each key that is rolled up, the first key's highest
    number = {sum(1 << (len(names) - 1 - k) for k, d in enumerate(names) if d not in s): i for i, s in enumerate(chosen)}
    which = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])[F.col("_id").cast("int")]
    return cells.select(which.alias("cuboid"), *[F.col(f"_k_{d}").alias(d) for d in names], *CELLS)


class Lattice:
    """Cuboids of one line-item frame, and which of them answers a set of dimensions."""

    def __init__(self, lines: DataFrame, chosen: list[Dims], size: Mapping[Dims, int], cells: DataFrame | None) -> None:
        self.lines, self.chosen, self.size, self.cells = lines, chosen, dict(size), cells

    @classmethod
    def of(
        cls, lines: DataFrame, wanted: Mapping[Dims, int], keep: Callable[[DataFrame], DataFrame], budget: int | None = None
    ) -> Lattice:
        """Choose, build and keep. ``keep`` writes the cells, a folder for each ``cuboid``, and reads them back."""
        number, size = sizes(lines, wanted)
        chosen = choose(number, size, wanted, max(SMALL, int(number * SHARE)) if budget is None else budget)
        return cls(lines, chosen, size, keep(build(lines, chosen)) if chosen else None)

    def answers(self, dims: Iterable[str]) -> Dims | None:
        """The smallest cuboid that keeps ``dims``; None if only the lines do."""
        dims = frozenset(dims)
        fit = [s for s in self.chosen if dims <= s]
        return min(fit, key=lambda s: (self.size[s], len(s), sorted(s))) if fit else None

    def rows(self, *dims: str) -> DataFrame:
        """Cells that keep ``dims``, or the lines."""
        best = self.answers(dims)
        if best is None:
            return self.lines
        return self.cells.where(F.col("cuboid") == self.chosen.index(best)).select(*sorted(best), *CELLS)


def wanted_by(reports: Iterable[Iterable[str]]) -> dict[Dims, int]:
    """How many reports want each set of dimensions."""
    return reduce(lambda out, dims: out | {dims: out.get(dims, 0) + 1}, map(frozenset, reports), {})
