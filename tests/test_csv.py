"""CSV source: quoting, Windows-1252, empty vs NULL, rounding, malformed rows."""

import os
import tempfile
from datetime import date
from decimal import Decimal as D

import pytest

from marginscope.sources.csv import cp1252_translation, read_line_items_csv

HEADER = ("Row ID,Order ID,Order Date,Ship Date,Ship Mode,Customer ID,Customer Name,Segment,Country,City,"
          "State,Postal Code,Region,Product ID,Category,Sub-Category,Product Name,Sales,Quantity,Discount,Profit")


def _line(i, name='"Xerox 1954, Recycled Paper, 8.5 x 11"', sales="261.965", profit="-1.005", city="Henderson",
          postal="02134"):
    return (f"{i},CA-2016-1,2016-11-08,2016-11-11,Second Class,CG-1,Claire Gute,Consumer,United States,{city},"
            f"Kentucky,{postal},South,OFF-PA-1,Office Supplies,Paper,{name},{sales},2,0.2,{profit}")


def _write(lines, encoding="cp1252"):
    d = tempfile.mkdtemp(prefix="run-csv-", dir="/tmp")
    p = os.path.join(d, "orders.csv")
    with open(p, "wb") as f:
        f.write(("\r\n".join([HEADER, *lines]) + "\r\n").encode(encoding))
    return p


def test_translation_table_is_the_cp1252_c1_block():
    src, dst = cp1252_translation()
    assert len(src) == len(dst) == 27
    assert dst[0] == "€"  # 0x80 is the euro sign


def test_torture(spark):
    lines = [
        _line(1),
        _line(2, name='"27"" monitor café “q”"'),
        _line(3, city='""'),           # quoted empty -> ''
        _line(4, city=""),             # unquoted empty -> NULL
        _line(5, postal="00501"),
    ]
    df = read_line_items_csv(spark, _write(lines))
    rows = {r.row_id: r for r in df.collect()}
    assert rows[1].product_name == "Xerox 1954, Recycled Paper, 8.5 x 11"
    assert rows[2].product_name == '27" monitor café “q”'
    assert rows[3].city == "" and rows[4].city is None
    assert rows[5].postal_code == "00501"
    assert rows[1].sales == D("261.97") and rows[1].profit == D("-1.01")  # half away from zero
    assert rows[1].discount == D("0.20") and rows[1].order_date == date(2016, 11, 8)


def test_malformed_rows_fail_the_gate(spark):
    lines = [_line(1), _line(2) + ",extra", "3,CA-2016-1,2016-11-08", _line(4)]
    p = _write(lines)
    with pytest.raises(ValueError, match="2 malformed"):
        read_line_items_csv(spark, p)
    rep = read_line_items_csv(spark, p, bad_rows="report")
    # counted correctly even when only a few columns are then selected
    assert rep.select("row_id", "_corrupt_record").where("_corrupt_record is not null").count() == 2
    assert rep.count() == 4


def test_roundtrip_to_parquet(spark):
    from marginscope.sources.table import read_line_items, write_line_items

    df = read_line_items_csv(spark, _write([_line(i) for i in range(1, 30)]))
    out = os.path.join(tempfile.mkdtemp(prefix="run-pq-", dir="/tmp"), "t")
    write_line_items(df, out)
    write_line_items(df, out)  # overwrite: a reload is idempotent
    assert read_line_items(spark, out).count() == 29


def test_line_items_survive_csv_round_trip(spark, li001):
    from marginscope.sources.table import line_items_via_csv

    back = line_items_via_csv(spark, "/root/testdata/sf0.001")
    assert back.schema == li001.schema
    assert back.exceptAll(li001).count() == 0 and li001.exceptAll(back).count() == 0


def test_writer_round_trips_awkward_text(spark):
    from marginscope.sources.csv import write_line_items_csv
    from marginscope.sources.schema import CSV_SCHEMA

    df = read_line_items_csv(spark, _write([
        _line(1, name='"27"" monitor café “q” – €5"'), _line(2, city='""'), _line(3, city=""),
    ]))
    out = os.path.join(tempfile.mkdtemp(prefix="run-csvw-", dir="/tmp"), "w")
    write_line_items_csv(df, out)
    back = read_line_items_csv(spark, out, schema=CSV_SCHEMA)
    assert sorted(back.collect()) == sorted(df.collect())


AWKWARD = ['say "hi", twice', " lead", "trail ", " both ", "", None, "Łódź 中", 'a,b', '""', "line\nbreak", "tab\there", "'", '"', "\\", '\\"']


def _awkward(spark):
    from pyspark.sql import functions as F

    from marginscope.sources.schema import CSV_SCHEMA

    base = read_line_items_csv(spark, _write([_line(i) for i in range(1, len(AWKWARD) + 1)]))
    names = spark.createDataFrame(list(enumerate(AWKWARD, 1)), "row_id int, _name string")
    df = base.join(names, "row_id").withColumn("customer_name", F.col("_name")).withColumn("product_name", F.col("_name"))
    return df.select(*[f.name for f in CSV_SCHEMA.fields])


def test_both_sinks_keep_every_character(spark):
    import csv
    import glob

    from marginscope.operators.export import enriched_export, read_extract, write_extract
    from marginscope.sources.csv import read_csv_raw, write_csv
    from marginscope.sources.schema import CSV_SCHEMA

    df = _awkward(spark)
    out = tempfile.mkdtemp(prefix="run-awk-", dir="/tmp")
    write_csv(df, out + "/lines")
    back = read_csv_raw(spark, out + "/lines", CSV_SCHEMA, charset="utf-8", multi_line=True).drop("_corrupt_record")
    assert sorted(back.collect(), key=lambda r: r.row_id) == sorted(df.collect(), key=lambda r: r.row_id)
    extract = enriched_export(df)
    write_extract(extract, out + "/extract")
    got = read_extract(spark, out + "/extract", row_id="int")
    assert sorted(got.collect(), key=lambda r: r.row_id) == sorted(extract.collect(), key=lambda r: r.row_id)
    # and Python's reader, which knows nothing of this module, sees 24 fields in every row
    names = {}
    for p in glob.glob(out + "/extract/part-*.csv"):
        with open(p, newline="", encoding="utf-8") as f:
            for row in csv.DictReader(f):
                assert None not in row and len(row) == 24
                names[int(row["row_id"])] = row["customer_name"]
    assert names == {k: v or "" for k, v in enumerate(AWKWARD, 1)}


def test_characters_outside_the_charset_raise(spark):
    from marginscope.sources.csv import write_csv, write_line_items_csv

    df = _awkward(spark)
    out = tempfile.mkdtemp(prefix="run-awk-", dir="/tmp")
    for charset in ("cp1252", "ISO-8859-1"):
        with pytest.raises(ValueError, match="1 row"):
            write_csv(df, out + "/x", charset=charset)
        assert not os.path.exists(out + "/x")
    write_line_items_csv(df.where("row_id <> 7"), out + "/y")


def test_bad_csv_leaves_the_old_table(spark):
    from marginscope.sources.csv import load_csv_table
    from marginscope.sources.table import read_line_items

    out = os.path.join(tempfile.mkdtemp(prefix="run-load-", dir="/tmp"), "t")
    t = load_csv_table(spark, _write([_line(i) for i in range(1, 6)]), out)
    assert t.count() == 5 and "_corrupt_record" not in t.columns
    with pytest.raises(ValueError, match="2 malformed"):
        load_csv_table(spark, _write([_line(1), _line(2) + ",extra", "3,CA-2016-1,2016-11-08"]), out)
    assert read_line_items(spark, out).count() == 5


def test_csv_load_sizes_its_files_by_rows(spark, monkeypatch):
    from marginscope.sources import table
    from marginscope.sources.csv import load_csv_table

    monkeypatch.setattr(table, "ROWS_PER_FILE", 3)
    out = os.path.join(tempfile.mkdtemp(prefix="run-load-", dir="/tmp"), "t")
    loaded = load_csv_table(spark, _write([_line(i) for i in range(1, 61)]), out)
    assert len(loaded.inputFiles()) == 20 and all(f.startswith(f"file://{out}/") for f in loaded.inputFiles())


def test_csv_report_scans_few_columns(spark):
    import __spark_entry__ as E

    plan = E.queries()["csv_source_tiers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert sorted(c.split(":")[0] for c in schema.split(",") if ":" in c) == ["discount", "profit", "sales"]


def test_us_date_format(spark):
    # The date text format is a parameter (the source export writes M/d/yyyy)
    line = _line(1).replace("2016-11-08,2016-11-11", "11/8/2016,11/11/2016")
    df = read_line_items_csv(spark, _write([line]), date_format="M/d/yyyy")
    r = df.first()
    assert (r.order_date, r.ship_date) == (date(2016, 11, 8), date(2016, 11, 11))
