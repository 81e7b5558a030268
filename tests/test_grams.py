"""Substring search by trigrams finds what a scan finds, in fewer blocks."""

import random

import pytest
from pyspark.sql import functions as F

from tallymill.operators.buckets import BUCKET, Buckets
from tallymill.operators.grams import Grams, grams_of
from tallymill.plans.roles import table

VALUES = ["cheque_id", "normalized_value"]


@pytest.fixture(scope="module")
def kept(spark, sf_dir, tmp_path_factory):
    fields = table(spark, sf_dir, "fields_").select("id", F.col("cheque_id").cast("string").alias("cheque_id"), "normalized_value").dropDuplicates(["id"])
    place = str(tmp_path_factory.mktemp("grams"))
    stored = Buckets(spark, f"{place}/rows", "id long, cheque_id string, normalized_value string", ["id"], 32)
    stored.merge(fields, 1)
    grams = Grams(spark, f"{place}/grams", 8)
    grams.add(stored.stored(), VALUES, 1)
    return stored, grams


def test_grams_of(spark):
    rows = spark.createDataFrame([("AbcAbC",), ("ab",), ("",), (None,), ("日本語だ",)], "v string")
    got = [sorted(r["g"]) for r in rows.select(grams_of(F.col("v")).alias("g")).collect()]
    assert got == [["abc", "bca", "cab"], [], [], [], ["日本語", "本語だ"]]


def test_as_a_scan(kept):
    stored, grams = kept
    held = [(r["id"], [(r[c] or "").lower() for c in VALUES]) for r in stored.rows().collect()]
    draw = random.Random(5)
    terms = ["₹1", "", "zzz", "₹12", "1" * 40]
    for _ in range(20):
        text = draw.choice(draw.choice(held)[1])
        a = draw.randrange(max(1, len(text) - 2))
        terms.append(text[a : a + draw.randrange(3, 8)])
    for term in terms:
        wanted = sorted(i for i, vs in held if any(term in v for v in vs))
        blocks = grams.blocks(term)
        got = sorted(r["id"] for r in grams.search(stored.stored(), VALUES, term).select("id").collect())
        assert got == wanted, term
        assert (blocks is None) == (len(term) < 3)


def test_reads_matching_blocks(spark, kept, tmp_path):
    stored, grams = kept
    row = spark.createDataFrame([(-7, "none", "QuixoticName")], "id long, cheque_id string, normalized_value string")
    stored.merge(row, 2)
    grams.add(stored.stored().where(F.col("id") == -7), VALUES, 2)
    grams.add(stored.stored().where(F.col("id") == -7), VALUES, 2)
    assert len(grams.blocks("quixOTIC")) == 1
    df = grams.search(stored.stored(), VALUES, "quixOTIC")
    assert [r["id"] for r in df.collect()] == [-7]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert BUCKET in plan.split("PartitionFilters: [")[1].split("]")[0]
    # changed: the old trigrams stay, the rows do not
    stored.merge(row.withColumn("normalized_value", F.lit("plain")), 3)
    assert grams.search(stored.stored(), VALUES, "quixotic").count() == 0
    before = {r["gram"]: sorted(r["blocks"]) for r in grams.posted().groupBy("gram").agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks")).collect()}
    grams.compact(9)
    grams.compact(9)
    assert {r["gram"]: r["blocks"] for r in grams.posted().collect()} == before
    assert {r["batch"] for r in grams.posted().select("batch").distinct().collect()} == {9}


def test_reads_own_folders(kept):
    _, grams = kept
    own = grams.posted().where(F.col("part") == grams.part(F.lit("123"))).where("gram = '123'")
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "xxhash64" not in plan
    assert own.count() == 1


def test_nothing_posted(spark, tmp_path):
    grams = Grams(spark, str(tmp_path / "none"))
    assert grams.blocks("abc") == [] and grams.blocks("ab") is None
