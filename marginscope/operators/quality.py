"""Data-quality operators.

Every row-level rule is one ``count_if`` in a single aggregate, so the
row rules cost one scan no matter how many there are. Key-level
rules (duplicate keys) are a group-by with map-side partial counts, so a
key holding a third of the rows is counted per task before the shuffle.
Row-returning forms (``violations``, ``duplicate_rows``) are filters and a
semi-join; nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import BUSINESS_KEY, DOMAIN_COLUMNS, NULL_CHECKED, VARCHAR_WIDTH


def default_rules(varchar_width: dict[str, int] | None = None) -> dict[str, Column]:
    """Row-level rules: the predicate is TRUE for a failing row (NULL passes)."""
    width = VARCHAR_WIDTH if varchar_width is None else varchar_width
    too_long = F.lit(False)
    for c, n in width.items():
        too_long = too_long | (F.length(c) > n)
    return {
        "null_row_id": F.col("row_id").isNull(),
        "ship_before_order": F.col("ship_date") < F.col("order_date"),
        "non_positive_sales": F.col("sales") <= 0,
        "non_positive_quantity": F.col("quantity") <= 0,
        "discount_out_of_range": (F.col("discount") < 0) | (F.col("discount") > 1),
        "stray_whitespace_customer_name": F.col("customer_name") != F.trim(F.col("customer_name")),
        "text_too_long": too_long,
    }


# Rules that report without failing the load (legitimate by design).
INFO_RULES = {"apparent_duplicate_keys"}


def key_stats(df: DataFrame, key: str = "row_id") -> DataFrame:
    """One row about a key column: distinct and repeated values, smallest and largest.

    One hash aggregate of the key alone (partial per task, so a repeated key is
    combined before the shuffle). The load profile and the quality report
    both read this row; materialise it once to share it.
    """
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.count(F.col(key)).alias("distinct_keys"),
        F.count_if(F.col("_n") > 1).alias("repeated_keys"),
        F.min(key).alias("min_key"),
        F.max(key).alias("max_key"),
    )


def load_profile(df: DataFrame, key: str = "row_id", date: str = "order_date", stats: DataFrame | None = None) -> DataFrame:
    """Row count, distinct keys, key range and date range.

    Rows and dates are a plain aggregate without a shuffle of lines; the keys come
    from ``stats`` (``key_stats`` of the same lines), computed here if absent. The
    range of a text key is in text order.
    """
    stats = key_stats(df, key) if stats is None else stats
    keys = stats.select(F.struct("distinct_keys", "min_key", "max_key")).scalar()  # one value
    lines = df.agg(F.count(F.lit(1)).alias("row_count"), F.min(date).alias("min_date"), F.max(date).alias("max_date"))
    return lines.select("row_count", *[keys[c].alias(c) for c in ("distinct_keys", "min_key", "max_key")], "min_date", "max_date")


def _key_dups(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count_if(F.col("n") > 1).alias("failures"))
        .select(F.lit(name).alias("rule"), "failures")
    )


def quality_report(
    df: DataFrame,
    rules: dict[str, Column] | None = None,
    key: Sequence[str] = ("row_id",),
    business_key: Sequence[str] = BUSINESS_KEY,
    stats: DataFrame | None = None,
) -> DataFrame:
    """One row per rule: ``rule, failures, passed``.

    Row rules share one scan; duplicate ``key`` values come from ``stats``
    (``key_stats`` of the same lines) or a group-by, apparent duplicates on
    ``business_key`` from another. Apparent duplicates are informational and
    always pass.
    """
    rules = default_rules() if rules is None else rules
    names = list(rules)
    wide = df.agg(*[F.count_if(p).alias(n) for n, p in rules.items()])
    row_rules = wide.unpivot([], names, "rule", "failures")
    if stats is not None:
        keys = stats.select(F.lit("duplicate_row_id").alias("rule"), F.col("repeated_keys").alias("failures"))
    else:
        keys = _key_dups(df, key, "duplicate_row_id")
    parts = row_rules.unionByName(keys)
    if business_key:
        parts = parts.unionByName(_key_dups(df, business_key, "apparent_duplicate_keys"))
    passed = (F.col("failures") == 0) | F.col("rule").isin(*INFO_RULES)
    return parts.select("rule", F.col("failures").cast("bigint").alias("failures"), passed.alias("passed"))


def violations(df: DataFrame, rule: str | Column, rules: dict[str, Column] | None = None) -> DataFrame:
    """The rows failing one rule (a filter that reaches the scan when it can)."""
    pred = rule if isinstance(rule, Column) else (default_rules() if rules is None else rules)[rule]
    return df.where(pred)


def assert_quality(
    df: DataFrame, rules: dict[str, Column] | None = None, allow: Sequence[str] = (), expected: dict | None = None
) -> DataFrame:
    """Raise if a rule or an expected value fails (other than those in ``allow``); return the report otherwise.

    The reports are a handful of rows, so collecting them is bounded. ``allow``
    names rules a data set is known to fail by construction (e.g. the test
    fixture's ship dates are independent of its order dates). ``expected`` are the
    arguments of ``expectations`` (row count, date range, key range, domain sizes).
    """
    rep = quality_report(df, rules)
    failed = [r["rule"] for r in rep.where(~F.col("passed")).collect() if r["rule"] not in allow]
    if expected:
        failed += [r["check"] for r in expectations(df, **expected).where(~F.col("passed")).collect() if r["check"] not in allow]
    if failed:
        raise ValueError(f"quality gate failed: {failed}")
    return rep


def null_profile(df: DataFrame, cols: Sequence[str] = NULL_CHECKED) -> DataFrame:
    """Long form ``column_name, nulls``: one scan for all columns."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column_name", "nulls")


def duplicate_keys(df: DataFrame, keys: Sequence[str], count_name: str = "occurrences") -> DataFrame:
    """Key values occurring more than once, with their count."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_name))
        .where(F.col(count_name) > 1)
        .orderBy(*keys)
    )


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key is duplicated: a null-safe semi-join to the duplicate keys.

    The key set is not size-bounded, so no broadcast hint; AQE splits a
    skewed key on the probe side of the semi-join.
    """
    dups = duplicate_keys(df, keys).select(*[F.col(k).alias(f"_dup_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(dups[f"_dup_{k}"])
    return df.join(dups, same, "left_semi")


def expectations(
    df: DataFrame,
    rows: int | None = None,
    dates: tuple | None = None,
    keys: tuple[str | Column, int, int] | None = None,
    domains: dict[str, int] | None = None,
    date: str = "order_date",
) -> DataFrame:
    """Expected values of a load against the actual ones: ``check, expected, actual, passed``.

    ``rows`` is the exact number of lines; ``dates`` the first and last date; ``keys``
    a whole-number key column (or expression) with its first and last value, of
    which none may be missing;
    ``domains`` the number of distinct values of a column. Values are text, so
    that one column holds them all. One scan, and a shuffle of the distinct
    keys and values only.
    """
    checks: list[tuple[str, str, Column]] = []
    if rows is not None:
        checks.append(("row_count", str(rows), F.count(F.lit(1))))
    if dates is not None:
        checks.append(("first_date", str(dates[0]), F.min(date)))
        checks.append(("last_date", str(dates[1]), F.max(date)))
    if keys is not None:
        key = F.col(keys[0]) if isinstance(keys[0], str) else keys[0]
        checks.append(("first_key", str(keys[1]), F.min(key)))
        checks.append(("last_key", str(keys[2]), F.max(key)))
        checks.append(("missing_keys", "0", F.lit(keys[2] - keys[1] + 1) - F.count_distinct(F.when(key.between(keys[1], keys[2]), key))))
    for c, n in (domains or {}).items():
        checks.append((f"values_of_{c}", str(n), F.count_distinct(c)))
    if not checks:
        raise ValueError("nothing is expected")
    names = [name for name, *_ in checks]
    wide = df.agg(*[F.coalesce(actual.cast("string"), F.lit("none")).alias(name) for name, _, actual in checks])
    expected = F.create_map(*[F.lit(x) for name, value, _ in checks for x in (name, value)])
    return wide.unpivot([], names, "check", "actual").select(
        "check", expected[F.col("check")].alias("expected"), "actual", (expected[F.col("check")] == F.col("actual")).alias("passed")
    )


def domain_values(df: DataFrame, cols: Sequence[str] = (*DOMAIN_COLUMNS, "discount")) -> DataFrame:
    """Distinct values of several columns in one scan: ``column_name, value``."""
    strs = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    return (
        strs.unpivot([], list(cols), "column_name", "value")
        .distinct()
        .orderBy("column_name", F.col("value").asc_nulls_last())
    )


def domain_counts(df: DataFrame, cols: Sequence[str] = (*DOMAIN_COLUMNS, "discount")) -> DataFrame:
    """Number of distinct non-NULL values per column: ``column_name, distinct_values``."""
    strs = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    return (
        strs.unpivot([], list(cols), "column_name", "value")
        .groupBy("column_name")
        .agg(F.count_distinct("value").alias("distinct_values"))
        .orderBy("column_name")
    )


def stray_whitespace(df: DataFrame, col: str = "customer_name") -> DataFrame:
    """Distinct values with blanks at either end."""
    return df.where(F.col(col) != F.trim(F.col(col))).select(col).distinct()
