"""Run the whole analysis: load -> gate -> line-item table -> every report.

    python -m marginscope --csv orders.csv --date-format M/d/yyyy --out /shared/run1
    python -m marginscope --parquet /shared/line_items --out /shared/run2 --reports discount_tiers,headline
    python -m marginscope --star /root/testdata/sf0.01 --out /shared/run3

Each report is written to ``OUT/reports/<name>`` (parquet, or CSV with a
header); a JSON summary (report -> path, row count) is printed at the end.
Row counts are counted from the written files, not collected.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from .operators.quality import expectations, quality_report
from .operators.export import write_extract
from .plans.catalog import build_reports
from .session import get_spark
from .sources.csv import load_csv_table
from .sources.star import line_items_from_star, star_counts
from .sources.table import read_line_items, reload_line_items


def parse_args(argv=None) -> argparse.Namespace:
    a = argparse.ArgumentParser(prog="marginscope", description=__doc__.split("\n")[0])
    src = a.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv", help="line-item CSV file or folder (header, comma, quote \")")
    src.add_argument("--parquet", help="an existing line-item parquet table")
    src.add_argument("--star", help="folder of TPC-H-like star tables (the test fixture)")
    a.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    a.add_argument("--charset", default="cp1252")
    a.add_argument("--date-format", default="yyyy-MM-dd")
    a.add_argument("--reports", default="", help="comma list; default: all")
    a.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    a.add_argument("--threshold", default="0.2", help="deep-discount threshold as a proportion")
    a.add_argument("--structural-dims", default="sub_category", help="comma list: grain of the structural losses")
    a.add_argument("--accounts", default="", help="comma list of customer names to profile (no such report without)")
    a.add_argument("--customer", default=None, help="customer for the regional profile and detail (no such reports without)")
    a.add_argument("--regions", default="", help="comma list: the filtered views show these regions only")
    a.add_argument("--categories", default="", help="comma list: the filtered views show these categories only")
    a.add_argument("--segments", default="", help="comma list: the filtered views show these segments only")
    a.add_argument("--from", dest="first_day", default=None, help="first order date of the filtered views (yyyy-MM-dd)")
    a.add_argument("--to", dest="last_day", default=None, help="last order date of the filtered views (yyyy-MM-dd)")
    a.add_argument("--expect-rows", type=int, default=None, help="stop unless the table holds so many lines")
    a.add_argument("--allow", default="", help="comma list of quality rules that may fail without stopping the run")
    a.add_argument("--no-gate", action="store_true", help="report quality but never stop")
    a.add_argument("--partition-by", default="", help="directory partitions of the table, e.g. order_year")
    a.add_argument("--master", default=None)
    return a.parse_args(argv)


def names_in(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(",") if x.strip())


def run(args: argparse.Namespace) -> dict:
    spark = get_spark(args.master)
    parts = [p for p in args.partition_by.split(",") if p]
    table = os.path.join(args.out, "line_items")
    if args.csv:
        li = load_csv_table(spark, args.csv, table, charset=args.charset, date_format=args.date_format,
                            partition_by=parts)
    elif args.star:
        counts = star_counts(spark, args.star)
        li = reload_line_items(spark, line_items_from_star(spark, args.star, counts), table, parts, counts["lineitem"])
    else:
        li = read_line_items(spark, args.parquet)

    rep = quality_report(li)
    allow = {r for r in args.allow.split(",") if r}
    failed = [r.rule for r in rep.collect() if not r.passed]  # one row per rule: bounded
    if args.expect_rows is not None:
        failed += [r.check for r in expectations(li, rows=args.expect_rows).collect() if not r.passed]
    blocking = [r for r in failed if r not in allow]
    if blocking and not args.no_gate:
        raise SystemExit(f"quality gate failed: {blocking}")

    filters = {k: v for k, v in (("regions", names_in(args.regions)), ("categories", names_in(args.categories)),
                                 ("segments", names_in(args.segments))) if v}
    if args.first_day or args.last_day:
        filters["date_range"] = (args.first_day or "0001-01-01", args.last_day or "9999-12-31")
    reports = build_reports(threshold=args.threshold, structural_dims=names_in(args.structural_dims),
                            named_accounts=names_in(args.accounts), named_customer=args.customer, filters=filters)
    names = [n for n in args.reports.split(",") if n] or list(reports)
    unknown = [n for n in names if n not in reports]
    if unknown:
        raise SystemExit(f"unknown reports: {unknown}")
    summary = {"line_items": args.parquet or table, "failed_rules": sorted(failed), "reports": {}}
    for name in names:
        path = os.path.join(args.out, "reports", name)
        write_extract(reports[name](li), path, fmt=args.format)
        r = spark.read.option("header", True).option("multiLine", True).option("escape", '"') if args.format == "csv" else spark.read
        rows = r.format(args.format).load(path).count()
        summary["reports"][name] = {"path": path, "rows": rows}
    return summary


def main(argv=None) -> None:
    print(json.dumps(run(parse_args(argv)), indent=1))


if __name__ == "__main__":
    main(sys.argv[1:])
