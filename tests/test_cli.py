"""The command-line run: load, gate, table, reports."""

import os
import tempfile

import pytest

from marginscope.__main__ import parse_args, run
from test_csv import _line, _write


def test_run_from_csv(spark):
    out = tempfile.mkdtemp(prefix="run-cli-", dir="/tmp")
    csv = _write([_line(i) for i in range(1, 40)])
    summary = run(parse_args(["--csv", csv, "--out", out, "--reports", "headline,discount_tiers,threshold_split",
                              "--customer", "Claire Gute"]))
    assert summary["failed_rules"] == []
    assert summary["reports"]["headline"]["rows"] == 1
    assert summary["reports"]["discount_tiers"]["rows"] == 1  # every line is at 20 %
    back = spark.read.parquet(os.path.join(out, "reports", "headline")).first()
    assert back.total_line_items == 39


def test_run_from_star_all_reports(spark):
    out = tempfile.mkdtemp(prefix="run-cli-", dir="/tmp")
    # sf0.001 holds one duplicated row_id and ships before ordering by construction (FIXTURES.md):
    # allowed here, still reported in the summary
    summary = run(parse_args(["--star", "/root/testdata/sf0.001", "--out", out, "--format", "csv",
                              "--accounts", "Customer#000000001,Customer#000000002", "--customer", "Customer#000000001",
                              "--allow", "ship_before_order,duplicate_row_id"]))
    assert summary["failed_rules"] == ["duplicate_row_id", "ship_before_order"]
    from marginscope.plans import REPORTS

    assert len(summary["reports"]) == len(REPORTS) == 54
    assert summary["reports"]["enriched_export"]["rows"] == 6000
    assert summary["reports"]["thin_margin_accounts"]["rows"] == 14


def test_gate_stops_run(spark):
    out = tempfile.mkdtemp(prefix="run-cli-", dir="/tmp")
    csv = _write([_line(1), _line(2, sales="-5.00")])
    with pytest.raises(SystemExit, match="non_positive_sales"):
        run(parse_args(["--csv", csv, "--out", out]))


def test_partitioned_table_from_cli(spark):
    out = tempfile.mkdtemp(prefix="run-cli-", dir="/tmp")
    summary = run(parse_args(["--star", "/root/testdata/sf0.001", "--out", out, "--reports", "headline,filtered_view",
                              "--partition-by", "order_year", "--allow", "ship_before_order,duplicate_row_id"]))
    (version,) = os.listdir(os.path.join(out, "line_items", "_versions"))
    years = sorted(n for n in os.listdir(os.path.join(out, "line_items", "_versions", version)) if n.startswith("order_year="))
    assert len(years) >= 5
    assert summary["reports"]["headline"]["rows"] == 1


def test_filters_and_grain_are_parameters(spark):
    out = tempfile.mkdtemp(prefix="run-cli-", dir="/tmp")
    allow = ["--allow", "ship_before_order,duplicate_row_id"]
    names = ["--reports", "filtered_view,structural_losses,by_state"]
    run(parse_args(["--star", "/root/testdata/sf0.001", "--out", out + "/a", *names, *allow]))
    everything = spark.read.parquet(out + "/a/reports/filtered_view")
    assert sorted(everything.collect()) == sorted(spark.read.parquet(out + "/a/reports/by_state").collect())
    assert "sub_category" in spark.read.parquet(out + "/a/reports/structural_losses").columns
    run(parse_args(["--star", "/root/testdata/sf0.001", "--out", out + "/b", *names, *allow, "--regions", "ASIA",
                    "--from", "1996-01-01", "--structural-dims", "customer_name,sub_category"]))
    some = spark.read.parquet(out + "/b/reports/filtered_view")
    assert 0 < some.count() < everything.count()
    assert "customer_name" in spark.read.parquet(out + "/b/reports/structural_losses").columns


def test_reports_on_names_need_names(spark):
    out = tempfile.mkdtemp(prefix="run-cli-", dir="/tmp")
    csv = _write([_line(1), _line(2)])
    summary = run(parse_args(["--csv", csv, "--out", out]))
    assert not {"named_account_profile", "customer_detail", "customer_by_region"} & set(summary["reports"])
    assert summary["reports"]["filtered_view"]["rows"] == 1


def test_expected_rows_stop_a_doubled_load(spark):
    out = tempfile.mkdtemp(prefix="run-cli-", dir="/tmp")
    csv = _write([_line(1), _line(2), _line(3)])
    with pytest.raises(SystemExit, match="row_count"):
        run(parse_args(["--csv", csv, "--out", out, "--expect-rows", "2", "--reports", "headline"]))
