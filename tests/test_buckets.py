"""Merges into stored tables: what is touched, what is not, and batches that come again."""

import os

import pytest
from pyspark.sql import functions as F

from tallymill.operators import buckets
from tallymill.operators.buckets import Buckets

SCHEMA = "id long, status string, score double"


def times(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{path}/data") for f in fs if f.endswith(".parquet")}


def state(table):
    return {r["id"]: (r["status"], r["score"]) for r in table.rows().collect()}


@pytest.fixture
def table(spark, tmp_path):
    made = Buckets(spark, str(tmp_path / "t"), SCHEMA, ["id"], 8)
    assert made.rows().count() == 0
    assert made.merge(spark.range(200).select("id", F.lit("new").alias("status"), (F.col("id") / 2).alias("score")), 1)
    return made


def test_only_touched_buckets_are_replaced(spark, table):
    before = times(table.path)
    touched = {r["bucket"] for r in table.stored().where("id in (3, 5)").collect()}
    changes = spark.createDataFrame([(3, "a", None, 1), (3, "b", None, 2), (5, None, 7.0, 1)], "id long, status string, score double, at int")
    assert table.merge(changes, 2, order="at")
    after, now = times(table.path), state(table)
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert kept and all(after.get(f) == before[f] for f in kept)
    assert not {f for f in before if f not in kept} & set(after)
    assert now[3] == ("b", None) and now[5] == (None, 7.0) and len(now) == 200
    assert all(v == ("new", k / 2) for k, v in now.items() if k not in (3, 5))
    # the same batch again changes nothing, not even a file
    assert not table.merge(changes.withColumn("status", F.lit("other")), 2, order="at")
    assert times(table.path) == after and state(table) == now
    assert table.done() == {1, 2}


def test_plan_reads_touched_buckets_only(spark, table):
    plan = table.stored().where(F.col("bucket").isin(1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan


def test_kinds_of_changes(spark, table):
    rows = [(1, None, 9.0, ["score"], None), (2, None, 9.0, None, None), (4, "x", None, ["status"], None), (6, None, None, None, True), (500, "added", None, None, None), (501, None, None, None, True), (None, "lost", None, None, None)]
    table.merge(spark.createDataFrame(rows, "id long, status string, score double, named array<string>, deleted boolean"), 2)
    now = state(table)
    assert (now[1], now[2], now[4], now[500]) == (("new", 9.0), (None, 9.0), ("x", 2.0), ("added", None))
    assert 6 not in now and 501 not in now and None not in now and len(now) == 200
    table.merge(spark.createDataFrame([(7, None, 3.0)], SCHEMA), 3, keep_nulls=True)
    table.merge(spark.createDataFrame([(8, "only")], "id long, status string"), 4)
    assert state(table)[7] == ("new", 3.0) and state(table)[8] == ("only", 4.0)
    table.merge(table.rows().select("id", F.lit(True).alias("deleted")), 5)
    assert state(table) == {}
    table.merge(spark.createDataFrame([(1, "back", 1.0)], SCHEMA), 6)
    assert state(table) == {1: ("back", 1.0)}


def test_repeated_keys_and_lost_batches(spark, table, monkeypatch):
    twice = spark.createDataFrame([(3, "a", 1.0), (3, "b", 1.0)], SCHEMA)
    before = state(table)
    with pytest.raises(ValueError, match="several rows"):
        table.merge(twice, 2)
    assert state(table) == before and table.done() == {1}
    # lost after the buckets were replaced and before the batch was told as done
    changes = spark.createDataFrame([(3, "c", 2.0), (900, "d", 3.0)], SCHEMA)
    replace = Buckets.replace
    monkeypatch.setattr(Buckets, "replace", lambda self, *a: (replace(self, *a), (_ for _ in ()).throw(RuntimeError("lost"))))
    with pytest.raises(RuntimeError):
        table.merge(changes, 2)
    monkeypatch.setattr(Buckets, "replace", replace)
    assert table.merge(changes, 2)
    assert state(table) == before | {3: ("c", 2.0), 900: ("d", 3.0)}


def test_large_buckets_are_several_files(spark, tmp_path, monkeypatch):
    """No task holds a whole bucket of a table that grows."""
    monkeypatch.setattr(buckets, "ROWS_A_TASK", 20)
    made = Buckets(spark, str(tmp_path / "large"), "id long, n long", ["id"], 2)
    made.merge(spark.range(400).select("id", (F.col("id") * 3).alias("n")), 1)
    made.merge(spark.range(390, 410).select("id", F.lit(7).alias("n")), 2)
    assert sorted((r["id"], r["n"]) for r in made.rows().collect()) == [(i, 7 if i >= 390 else 3 * i) for i in range(410)]
    sizes = made.stored().groupBy(F.col("_metadata.file_path"), "bucket").count().collect()
    assert len({r["bucket"] for r in sizes}) == 2 and len(sizes) > 8 and max(r["count"] for r in sizes) < 100
