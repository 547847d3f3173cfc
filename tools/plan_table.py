"""Summarise every registered query's physical plan as a markdown table (PLANS.md)."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marginscope.plans import QUERIES  # noqa: E402
from marginscope.plans.catalog import CUBOID_DIMS  # noqa: E402
from marginscope.session import get_spark  # noqa: E402
from tools.plans import formatted  # noqa: E402

NOTES = {
    "load_profile": "one-row aggregate of the lines; the keys come from one shared hash aggregate of row_id (materialised as a single row)",
    "quality_report": "all row rules in one scan; repeated keys from the shared key row, apparent duplicates from a group-by with partial counts",
    "ship_before_order": "filter of two columns against each other: no shuffle, but nothing a scan could prune by",
    "null_profile": "one-row aggregate of all columns: partial per task, one merge",
    "recoverable_profit": "one-row conditional aggregate: partial per task, one merge",
    "loss_concentration": "one-row conditional aggregate: partial per task, one merge",
    "by_segment": "reads the order aggregate; distinct orders are a sum of flags, so only groups are shuffled",
    "domain_counts": "7 columns unpivoted in one scan; exact distinct per column",
    "domain_values": "7 columns unpivoted in one scan, partial distinct",
    "apparent_duplicate_rows": "semi-join to the duplicate keys (AQE broadcasts them at runtime when small)",
    "headline": "reads the order aggregate; distinct orders are a sum of flags",
    "tier_sign_rollup": "second-level rollup over 4 tiers; the share window sees 2 rows",
    "subcat_rank_in_region": "rank over the (region, brand) aggregate: bounded by the catalogue",
    "bottom3_subcats": "rank <= 3 becomes a partial WindowGroupLimit before the shuffle",
    "top5_customers_in_region": "reads the customer aggregate; rank <= 5 becomes a partial WindowGroupLimit before the shuffle",
    "monthly_running_total": "single-partition window over the month series (hundreds of rows)",
    "mom_growth": "single-partition window over the month series (hundreds of rows)",
    "moving_avg_3m": "single-partition window over the month series (hundreds of rows)",
    "top_customers": "reads the order aggregate; per-task top-k then merge (TakeOrderedAndProject)",
    "top_customers_by_profit": "reads the order aggregate; per-task top-k then merge (TakeOrderedAndProject)",
    "multi_region_accounts": "reads the customer aggregate; per-task top-k then merge (TakeOrderedAndProject)",
    "thin_margin_accounts": "distributed NTILE: ranges checkpointed, per-range offsets broadcast (one row per partition); deciles shared by the 4 decile reports",
    "top_decile_thin_margin": "reuses the checkpointed deciles",
    "flagged_account_profile": "customer aggregate semi-joined to the flagged keys, then grouped",
    "flagged_vs_company": "as above; company average is a scalar subquery over the customer aggregate",
    "named_account_profile": "IN-list pushed to the scan of the customer aggregate (no line scan)",
    "customer_by_region": "filter pushed to the scan of the customer aggregate (no line scan)",
    "customer_detail": "equality pushed to the parquet scan, where bloom filters skip row groups; range sort of the matches",
    "enriched_export": "range-partitioned global sort by row_id (no single task)",
    "filtered_view": "all dashboard filters pushed to the scan (IN lists, date range)",
    "filtered_subcategory_view": "same filters, pushed to the scan",
    "filtered_monthly_view": "same filters, pushed to the scan",
    "filtered_trend_view": "same filters, pushed to the scan; five exact sums",
    "discount_trend": "five exact decimal sums: partial per task, one merge",
    "csv_source_tiers": "tier report over the table loaded from the CSV copy: three columns of parquet",
    "by_category_subcategory": "group-by with partial aggregation; sorted report",
    "monthly_summary": "group-by on the month bucket (a DATE), partial aggregation",
}


def summary(txt: str) -> dict:
    tree = txt.split("\n\n\n")[0]
    return {
        "hash": len(re.findall(r"Arguments: hashpartitioning", txt)),
        "range": len(re.findall(r"Arguments: rangepartitioning", txt)),
        "single": len(re.findall(r"Arguments: SinglePartition", txt)),
        "bcast": tree.count("BroadcastExchange"),
        "window": tree.count("+- Window") + tree.count(":- Window"),
        "wgl": tree.count("WindowGroupLimit"),
        "topk": tree.count("TakeOrderedAndProject"),
        "pushed": "; ".join(sorted({
            re.sub(r"IsNotNull\([^)]*\),? ?", "", m).strip(", ")
            for m in re.findall(r"PushedFilters: \[(.*)\]\n", txt)
        } - {""})),
    }


def note(name: str) -> str:
    cells = "cells of the smallest cuboid, no line scan" if name in CUBOID_DIMS else ""
    return "; ".join(x for x in (cells, NOTES.get(name, "")) if x)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", 8)
    lines = [
        "| report | hash shuffles | range shuffles | single-partition | broadcasts | windows | group-limit | top-k | pushed filters | scale note |",
        "|---|---:|---:|---:|---:|---:|---:|---:|---|---|",
    ]
    for n, q in QUERIES.items():
        s = summary(formatted(q(spark, sf_dir)))
        pushed = s["pushed"].replace("|", "/")[:90]
        lines.append(f"| {n} | {s['hash']} | {s['range']} | {s['single']} | {s['bcast']} | {s['window']} | "
                     f"{s['wgl']} | {s['topk']} | {pushed} | {note(n)} |")
    print("\n".join(lines))


if __name__ == "__main__":
    main()
