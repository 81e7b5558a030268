"""Deep pages are those of a sort, and read the ranges that hold them."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from tallymill.operators import ledger
from tallymill.operators import pages as pages_module
from tallymill.operators.pages import RANGE, Pages
from tallymill.plans.roles import table


@pytest.fixture(scope="module")
def kept(spark, sf_dir, tmp_path_factory):
    rows = table(spark, sf_dir, "documents_").select("id", "created_at", "status", "review_required")
    # many equal timestamps, some missing, some facets null
    rows = rows.withColumn("created_at", F.when(F.col("id") % 3 == 0, F.lit("2024-01-01").cast("timestamp")).when(F.col("id") % 10 != 1, F.col("created_at").cast("timestamp")))
    rows = rows.withColumn("status", F.when(F.col("id") % 7 != 0, F.col("status"))).cache()
    pages = Pages(spark, str(tmp_path_factory.mktemp("pages")))
    pages.store(rows, 120)
    return rows, pages


SOME = {"status": "PROCESSED", "review_required": True}


@pytest.mark.parametrize("skip,limit,wanted", [(0, 50, {}), (119, 3, {}), (1490, 50, {}), (5000, 10, {}), (10, 0, SOME), (250, 400, {"status": "VERIFIED"}), (90, 30, SOME)])
def test_pages(kept, skip, limit, wanted):
    rows, pages = kept
    got = [r["id"] for r in pages.page(skip, limit, **wanted).collect()]
    assert got == [r["id"] for r in ledger.page(rows, skip, limit, **wanted).collect()]


def test_null_facet_and_total(kept):
    rows, pages = kept
    assert pages.total(status=None) == rows.where("status is null").count() and pages.total() == rows.count()
    with pytest.raises(ValueError):
        pages.page(0, 1, amount=3)


def test_seek(kept):
    rows, pages = kept
    whole = [(r["created_at"], r["id"]) for r in rows.orderBy(F.desc("created_at"), F.desc("id")).collect()]
    for at in (0, 118, 400, 777, len(whole) - 3, len(whole) - 1):
        got = [(r["created_at"], r["id"]) for r in pages.after(*whole[at], 130).collect()]
        assert got == whole[at + 1 : at + 131]
    # a place that no row holds
    place = (datetime.datetime(2024, 1, 1), 10**9)
    got = [r["id"] for r in pages.after(*place, 40, status="VERIFIED").collect()]
    wanted = rows.where((F.col("created_at") <= F.lit(place[0])) | F.col("created_at").isNull()).where("status = 'VERIFIED'")
    assert got == [r["id"] for r in wanted.orderBy(F.desc("created_at"), F.desc("id")).limit(40).collect()]


def test_reads_few_ranges(spark, kept):
    rows, pages = kept
    sizes = [r["count"] for r in pages.rows().groupBy(RANGE).count().collect()]
    assert max(sizes) <= 2 * rows.count() / len(sizes) and len(sizes) >= 10
    df = pages.page(1000, 20)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    held = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert RANGE in held
    touched = set()
    before = 0
    for p, n in pages.counts({}):
        if before < 1020 and before + n > 1000:
            touched.add(p)
        before += n
    # the filter names these ranges and no other
    assert len(touched) <= 2 and sorted(touched) == sorted(map(int, re.findall(r"(?<![#\w])\d+", held)))


def test_one_row_and_none(spark, tmp_path):
    one = spark.createDataFrame([(1, None, "A", True)], "id long, created_at timestamp, status string, review_required boolean")
    pages = Pages(spark, str(tmp_path / "one"))
    pages.store(one)
    assert [r["id"] for r in pages.page().collect()] == [1] and pages.page(1).count() == 0
    assert pages.after(None, 2).count() == 1 and pages.after(None, 1).count() == 0
    none = Pages(spark, str(tmp_path / "none"))
    none.store(one.limit(0))
    assert none.page().count() == 0 and none.total() == 0 and none.after(None, 1).columns == one.columns


def test_ranges_are_bounded(spark, tmp_path, monkeypatch):
    """A longer list has longer ranges, not ever more of them."""
    monkeypatch.setattr(pages_module, "MOST_RANGES", 8)
    rows = spark.range(500).select("id", F.timestamp_seconds(F.col("id") % 97).alias("created_at"), F.lit("VERIFIED").alias("status"), (F.col("id") % 3 == 0).alias("review_required"))
    pages = Pages(spark, str(tmp_path / "many"))
    pages.store(rows, 10)
    assert len(pages.counts({})) <= 8 and pages.total() == 500
    wanted = sorted(((r["created_at"], r["id"]) for r in rows.collect()), reverse=True)
    for skip in (0, 240, 490):
        assert [(r["created_at"], r["id"]) for r in pages.page(skip, 25).collect()] == wanted[skip : skip + 25]
