"""Ranking within groups (O15), and NTILE / RANK without a single-task window.

``rank_within`` aggregates first and ranks the aggregate; with ``n`` the
``rank <= n`` filter sits right on the window, which Catalyst turns into a
WindowGroupLimit before the shuffle (each task keeps only its top rows per
group), so a group with millions of members never moves whole.

``ntile`` over a whole table is a window with no partition key: Spark runs it
as one task. ``ntile_distributed`` computes the same buckets with every step
partitioned: range-partition on the (total) order, number rows within each
range, add the row counts of the ranges before it, and map the global row
number to its bucket with the NTILE formula. ``rank_distributed`` does the
same for RANK within groups of any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_IDX_BITS = 33  # monotonically_increasing_id = partition index << 33 | row index


def rank_within(
    df: DataFrame,
    group: str | Sequence[str],
    item: str | Sequence[str],
    measure: str = "profit",
    ascending: bool = False,
    n: int | None = None,
    rank_name: str = "rank",
    value_name: str = "total_profit",
    distributed: bool | None = None,
) -> DataFrame:
    """Sum ``measure`` per (group, item) and RANK items within each group.

    Ties share a rank and leave gaps (RANK, not ROW_NUMBER), so ``n`` may
    return more than ``n`` rows per group.

    With ``n`` the per-task WindowGroupLimit keeps the shuffle small for any
    number of items. Without ``n`` the items are ranked without a per-group task
    (``rank_distributed``); ``distributed=False`` ranks each group in one task, for item domains
    that are known to be small (brands or sub-categories within a region).
    """
    distributed = n is None if distributed is None else distributed
    group = [group] if isinstance(group, str) else list(group)
    item = [item] if isinstance(item, str) else list(item)
    agg = df.groupBy(*group, *item).agg(F.sum(measure).alias(value_name))
    v = F.col(value_name)
    if distributed:
        ranked = rank_distributed(agg, group, value_name, ascending, rank_name)
    else:
        w = Window.partitionBy(*group).orderBy(v.asc_nulls_last() if ascending else v.desc_nulls_first())
        ranked = agg.withColumn(rank_name, F.rank().over(w))
    if n is not None:
        ranked = ranked.where(F.col(rank_name) <= n)
    return ranked.select(
        *group, *item, v.cast("double").alias(value_name), rank_name
    ).orderBy(*group, rank_name, *item)


def ntile_bucket(rn: str, total: str, k: int) -> Column:
    """NTILE(k) bucket of 1-based row number column ``rn`` among ``total`` rows.

    The first ``total % k`` buckets hold one row more than the others.
    Integer arithmetic only (``div``), exact for any row count.
    """
    q = f"({total} div {k})"
    big = f"(({total} % {k}) * ({q} + 1))"
    return F.expr(
        f"CAST(CASE WHEN {rn} <= {big} THEN ({rn} - 1) div ({q} + 1) + 1 "
        f"ELSE ({total} % {k}) + ({rn} - {big} - 1) div nullif({q}, 0) + 1 END AS INT)"
    )


def ntile_distributed(df: DataFrame, k: int, order: Sequence[Column], name: str = "ntile") -> DataFrame:
    """``df`` plus NTILE(k) over ``order`` without a single-partition window.

    ``order`` must be a total order (end it with a unique key) so the result
    is deterministic. The range-partitioned, numbered rows are checkpointed
    (reliably, to the session's checkpoint folder) so that the row numbers
    and the per-range counts come from the very same ranges, also after a
    task or executor is lost and recomputed.
    """
    numbered = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    pid = F.shiftright(F.col("_mid"), _IDX_BITS).alias("_pid")
    idx = F.col("_mid").bitwiseAND(F.lit((1 << _IDX_BITS) - 1))
    counts = numbered.groupBy(pid).agg(F.count(F.lit(1)).alias("_n"))
    # One row per range partition: bounded by the partition count, not the data.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"),
    )
    return (
        numbered.withColumn("_pid", F.shiftright(F.col("_mid"), _IDX_BITS))
        .join(F.broadcast(offsets), "_pid")
        .withColumn("_rn", F.col("_off") + idx + 1)
        .withColumn(name, ntile_bucket("_rn", "_total", k))
        .drop("_pid", "_mid", "_off", "_total", "_rn")
    )


def rank_distributed(
    df: DataFrame, group: Sequence[str], value: str, ascending: bool = False, name: str = "rank"
) -> DataFrame:
    """``df`` plus RANK() OVER (PARTITION BY group ORDER BY value) with no per-group task.

    RANK of a row is 1 + the number of rows of its group with a strictly
    better value. The rows are first counted per (group, value); a segmented
    prefix sum of those counts in (group, value) order then gives the rank of
    each distinct value: range-partition the counts (checkpointed, so both
    passes see the same ranges), sum within each range per group, and add
    the totals of the group in earlier ranges. The windows involved see one
    range partition, or one row per range partition and group, never a whole
    group. The rank is joined back on (group, value), null-safe.
    """
    group = list(group)
    v = F.col(value)
    vorder = v.asc_nulls_last() if ascending else v.desc_nulls_first()
    order = [*[F.col(g).asc_nulls_last() for g in group], vorder]
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    numbered = (
        counts.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.shiftright(F.monotonically_increasing_id(), _IDX_BITS))
        .checkpoint(eager=True)
    )
    before = Window.partitionBy("_pid", *group).orderBy(vorder).rowsBetween(Window.unboundedPreceding, -1)
    local = numbered.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    totals = numbered.groupBy("_pid", *group).agg(F.sum("_c").alias("_t"))
    earlier = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *group, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_off"))
    keys = ["_pid", *group]
    ranks = (
        local.alias("l").join(offsets.alias("o"), [F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys])
        .select(*[F.col(f"l.{g}").alias(f"_g{i}") for i, g in enumerate(group)],
                F.col(f"l.{value}").alias("_v"),
                (F.lit(1) + F.col("o._off") + F.col("l._before")).cast("int").alias(name))
    )
    cond = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [v.eqNullSafe(F.col("_v"))]
    return df.join(ranks, cond).drop(*[f"_g{i}" for i in range(len(group))], "_v")
