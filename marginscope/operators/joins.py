"""Join helpers: broadcasts within one joint, checked budget of bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes that all broadcast sides of one plan may take together in every task's memory.
BROADCAST_BYTES = 256 << 20
# Of a broadcast row, besides 8 a column and its texts: null bits, its place in the hash table.
ENTRY_BYTES = 48


def row_counts(frames: dict[str, DataFrame]) -> dict[str, int]:
    """Row counts of several frames in one job (one small row per frame)."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("k"), "n") for k, df in frames.items()]
    return {r.k: r.n for r in reduce(DataFrame.unionAll, parts).collect()}


def row_bytes(frames: dict[str, DataFrame]) -> dict[str, int]:
    """Bytes that several frames take as broadcast sides, by the lengths of their texts, in one job."""
    parts = []
    for k, df in frames.items():
        row = F.lit(ENTRY_BYTES + 8 * len(df.columns)).cast("long")
        for f in df.schema.fields:
            if f.dataType.typeName() == "string":
                row = row + F.coalesce(F.octet_length(f.name) + 7, F.lit(0))
        parts.append(df.agg(F.coalesce(F.sum(row), F.lit(0)).alias("n")).select(F.lit(k).alias("k"), "n"))
    return {r.k: r.n for r in reduce(DataFrame.unionAll, parts).collect()}


def within_budget(sizes: dict[str, int], budget: int | None = None) -> set[str]:
    """The sides to broadcast: the smallest ones whose bytes fit the budget together.

    ``sizes`` must bound each side's bytes (counted rows times a row's upper
    estimate, or ``row_bytes``). The others are left to the planner: a sort-merge join, which
    adaptive execution turns into a broadcast only when runtime sizes allow,
    and whose skewed keys it splits.
    """
    left = BROADCAST_BYTES if budget is None else budget
    out = set()
    for name, size in sorted(sizes.items(), key=lambda x: (x[1], x[0])):
        if size > left:
            break
        out.add(name)
        left -= size
    return out
