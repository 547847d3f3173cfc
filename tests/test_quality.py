"""Quality gate on planted defects (one row per defect)."""

from datetime import date
from decimal import Decimal as D

import pytest

from marginscope.operators import quality as Q
from marginscope.sources.schema import CSV_SCHEMA


def _row(i, **kw):
    base = dict(
        row_id=i, order_id=f"O{i}", order_date=date(2020, 1, 1), ship_date=date(2020, 1, 3), ship_mode="Std",
        customer_id=f"C{i}", customer_name=f"Cust {i}", segment="Consumer", country="US", city="X",
        state="S", postal_code="01234", region="East", product_id=f"P{i}", category="Cat", sub_category="Sub",
        product_name="Thing", sales=D("10.00"), quantity=1, discount=D("0.10"), profit=D("1.00"),
    )
    base.update(kw)
    return tuple(base[f.name] for f in CSV_SCHEMA.fields)


@pytest.fixture(scope="module")
def defects(spark):
    rows = [_row(i) for i in range(1, 6)]
    rows += [
        _row(6, ship_date=date(2019, 12, 31)),            # ships before ordered
        _row(7, sales=D("0.00")),                          # non-positive sales
        _row(8, quantity=0),                               # non-positive quantity
        _row(9, discount=D("1.50")),                       # discount out of range
        _row(10, customer_name=" Padded "),                # stray whitespace
        _row(11, row_id=None),                             # misaligned row
        _row(5),                                           # duplicate row_id 5
        _row(12, order_id="O1", product_id="P1", customer_id="C1"),  # apparent duplicate of row 1
        _row(13, postal_code="123456789012"),              # wider than VARCHAR(10)
        _row(14, discount=None),                           # NULL discount: not a range failure
    ]
    return spark.createDataFrame(rows, CSV_SCHEMA)


def test_report_counts_each_defect(defects):
    rep = {r.rule: (r.failures, r.passed) for r in Q.quality_report(defects).collect()}
    assert rep == {
        "null_row_id": (1, False),
        "ship_before_order": (1, False),
        "non_positive_sales": (1, False),
        "non_positive_quantity": (1, False),
        "discount_out_of_range": (1, False),
        "stray_whitespace_customer_name": (1, False),
        "text_too_long": (1, False),
        "duplicate_row_id": (1, False),
        "apparent_duplicate_keys": (2, True),  # keys of rows 1 and 5 (row 5 copied whole)
    }


def test_gate_raises(defects):
    with pytest.raises(ValueError, match="quality gate failed"):
        Q.assert_quality(defects)


def test_violations_rows(defects):
    assert [r.row_id for r in Q.violations(defects, "discount_out_of_range").collect()] == [9]
    assert [r.row_id for r in Q.violations(defects, "ship_before_order").collect()] == [6]


def test_duplicates_are_reported_not_removed(defects):
    keys = Q.duplicate_keys(defects, ["row_id"]).collect()
    assert [(k.row_id, k.occurrences) for k in keys] == [(5, 2)]
    rows = Q.duplicate_rows(defects, ["order_id", "product_id", "customer_id", "order_date"])
    assert sorted(r.row_id for r in rows.collect()) == [1, 5, 5, 12]
    assert defects.count() == 15


def test_null_profile(defects):
    prof = {r.column_name: r.nulls for r in Q.null_profile(defects).collect()}
    assert prof["row_id"] == 1 and prof["discount"] == 1 and prof["sales"] == 0
    assert len(prof) == 14


def test_domains(defects):
    counts = {r.column_name: r.distinct_values for r in Q.domain_counts(defects).collect()}
    assert counts["segment"] == 1 and counts["discount"] == 2
    vals = [(r.column_name, r.value) for r in Q.domain_values(defects).collect()]
    assert ("discount", "0.10") in vals and ("discount", "1.50") in vals and ("discount", None) in vals
    assert [c for c, _ in vals] == sorted(c for c, _ in vals)


def test_clean_passes(spark):
    df = spark.createDataFrame([_row(i) for i in range(1, 4)], CSV_SCHEMA)
    rep = Q.assert_quality(df)
    assert all(r.passed for r in rep.collect())


def test_load_profile(defects):
    r = Q.load_profile(defects).first()
    assert (r.row_count, r.distinct_keys, r.min_key, r.max_key) == (15, 13, 1, 14)


def test_duplicate_rows_with_null_keys(spark):
    from marginscope.operators.quality import duplicate_keys, duplicate_rows

    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", "x"), (4, "b", "x"), (5, "c", None), (6, None, None)], "id int, o string, c string")
    assert duplicate_keys(df, ["o", "c"]).count() == 2
    assert sorted(r.id for r in duplicate_rows(df, ["o", "c"]).collect()) == [1, 2, 3, 4]


def test_expectations_find_a_doubled_load(spark, li001):
    import pytest

    from marginscope.operators.quality import assert_quality, expectations

    allow = ("ship_before_order", "duplicate_row_id")
    expected = {"rows": 6000, "domains": {"region": 5}}
    assert_quality(li001, allow=allow, expected=expected)
    with pytest.raises(ValueError, match="row_count"):
        assert_quality(li001.unionAll(li001), allow=allow, expected=expected)
    with pytest.raises(ValueError, match="values_of_region"):
        assert_quality(li001.where("region <> 'ASIA'"), allow=(*allow, "row_count"), expected=expected)
    df = spark.createDataFrame([(1,), (2,), (4,)], "row_id int")
    got = {r.check: (r.expected, r.actual, r.passed) for r in expectations(df, keys=("row_id", 1, 4)).collect()}
    assert got == {"first_key": ("1", "1", True), "last_key": ("4", "4", True), "missing_keys": ("0", "1", False)}
    empty = {r.check: r.passed for r in expectations(df.where("false"), rows=0, keys=("row_id", 1, 2)).collect()}
    assert empty == {"row_count": True, "first_key": False, "last_key": False, "missing_keys": False}


def test_defects_are_found(spark):
    import __spark_entry__ as E

    for name, q in E.queries().items():
        if name.startswith("defect_"):
            assert q(spark, "/root/testdata/sf0.01").count() > 0, name
