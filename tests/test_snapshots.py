"""Reloads under readers: versions, the manifest that is written last, removal by age."""

from __future__ import annotations

import os
import tempfile
import threading

import pytest
from pyspark.sql import functions as F

from marginscope.sources import snapshots as S
from marginscope.sources.table import read_line_items, reload_line_items


@pytest.fixture
def table():
    return tempfile.mkdtemp(prefix="marginscope-table-") + "/lines"


def load(spark, table, n, start=0):
    return S.commit(spark, table, lambda path: spark.range(start, start + n, 1, 3).write.parquet(path))


def failing(spark):
    """Rows of which some are written before a task fails."""
    ids = spark.range(0, 1000, 1, 4)
    return ids.select(F.when(F.col("id") == 900, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))


def test_versions_follow_each_other(spark, table):
    assert S.newest(spark, table) is None and S.manifests(spark, table) == []
    with pytest.raises(FileNotFoundError):
        S.read(spark, table)
    first, second = load(spark, table, 10), load(spark, table, 20)
    assert (first.version, second.version, second.rows) == (1, 2, 20)
    assert S.read(spark, table).count() == 20 and S.read(spark, table, 1).count() == 10
    with pytest.raises(FileNotFoundError):
        S.read(spark, table, 7)


def test_a_load_that_fails_halfway_leaves_the_table(spark, table):
    load(spark, table, 10)
    with pytest.raises(Exception, match="lost"):
        S.commit(spark, table, lambda path: failing(spark).write.parquet(path))
    assert S.newest(spark, table).version == 1 and S.read(spark, table).count() == 10
    # files were written, but no manifest
    with pytest.raises(ValueError, match="too few"):
        S.commit(spark, table, lambda path: spark.range(3).write.parquet(path), check=_refuse)
    assert S.read(spark, table).count() == 10
    assert load(spark, table, 30).version == 2 and S.read(spark, table).count() == 30


def _refuse(rows):
    raise ValueError(f"{rows} are too few")


def test_a_reader_sees_one_version_during_reloads(spark, table):
    load(spark, table, 100)
    reader = S.read(spark, table)
    seen, stop = [], threading.Event()

    def look():
        while not stop.is_set():
            r = S.read(spark, table).agg(F.count("*"), F.min("id"), F.max("id")).first()
            seen.append(tuple(r))

    t = threading.Thread(target=look)
    t.start()
    try:
        for k in range(1, 4):
            load(spark, table, 100, start=1000 * k)
    finally:
        stop.set()
        t.join()
    # never a mixture, never nothing
    assert set(seen) <= {(100, 1000 * k, 1000 * k + 99) for k in range(4)} and seen
    assert reader.agg(F.max("id")).first()[0] == 99


def test_two_loads_at_once(spark, table):
    load(spark, table, 1)

    def slow(path):
        spark.range(5).write.parquet(path)
        load(spark, table, 2)  # another load ends first

    with pytest.raises(S.ReloadConflict):
        S.commit(spark, table, slow)
    assert S.read(spark, table).count() == 2


def test_a_torn_manifest_is_passed_over(spark, table):
    load(spark, table, 10)
    with open(f"{table}/{S.MANIFESTS}/0000000002.json", "w") as f:
        f.write('{"version": 2, "fol')
    assert S.newest(spark, table).version == 1 and S.read(spark, table).count() == 10


def test_expire(spark, table):
    made = [load(spark, table, n) for n in (1, 2, 3, 4)]
    with pytest.raises(Exception, match="lost"):
        S.commit(spark, table, lambda path: failing(spark).write.parquet(path))
    assert S.expire(spark, table, older_than=3600) == []  # all too young
    later = made[-1].written_at + 7200
    removed = S.expire(spark, table, older_than=3600, keep=2, now=later)
    assert removed[:2] == [made[0].folder, made[1].folder] and len(removed) == 3  # and the failed load
    assert [m.version for m in S.manifests(spark, table)] == [3, 4]
    assert sorted(os.listdir(f"{table}/{S.VERSIONS}")) == [made[2].folder, made[3].folder]
    # a version goes by when it was replaced, not by when it was written
    assert S.expire(spark, table, older_than=3600, now=made[3].written_at + 10) == []
    assert S.read(spark, table).count() == 4
    with pytest.raises(ValueError):
        S.expire(spark, table, 0, keep=0)


def test_line_items_reload(spark, li001, table):
    n = li001.count()
    first = reload_line_items(spark, li001, table, rows=n)
    assert first.count() == n and first.columns == li001.columns
    with pytest.raises(ValueError, match="source lines became"):
        reload_line_items(spark, li001.limit(5), table, rows=n)
    assert read_line_items(spark, table).count() == n
    half = reload_line_items(spark, li001.where("quantity > 25"), table, partition_by=["order_year"])
    assert "order_year" in half.columns and half.count() < n
    assert first.count() == n  # the frame stays with its version


def test_reading_back_while_reloading_from_itself(spark, li001, table):
    reload_line_items(spark, li001, table)
    doubled = read_line_items(spark, table).unionAll(read_line_items(spark, table))
    assert reload_line_items(spark, doubled, table).count() == 2 * li001.count()
