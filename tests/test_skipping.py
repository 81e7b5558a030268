"""Look-ups open the files that may hold a key, and find what a scan finds."""

import pytest
from pyspark.sql import functions as F

from tallymill.plans.roles import table
from tallymill.sources.skipping import Skipping


@pytest.fixture(scope="module")
def kept(spark, sf_dir, tmp_path_factory):
    rows = table(spark, sf_dir, "documents_").select("id", F.sha2(F.col("cheque_identifier"), 256).alias("image_hash"))
    rows = rows.union(rows.limit(5)).union(rows.limit(3).withColumn("image_hash", F.lit(None).cast("string"))).cache()
    held = Skipping(spark, str(tmp_path_factory.mktemp("skipping")), "image_hash")
    held.store(rows, 200)
    return rows, held


def test_zones_and_rows(kept):
    rows, held = kept
    assert sorted(map(str, held.rows().collect())) == sorted(map(str, rows.collect()))
    zones = held.zones().collect()
    assert len(zones) >= 7 and sum(z["n"] for z in zones) == rows.count() and sum(z["nulls"] for z in zones) == 3
    assert max(z["n"] for z in zones) <= 200


def test_present_keys_are_found(kept):
    rows, held = kept
    for r in rows.where("image_hash is not null").limit(6).collect():
        got = held.lookup(r["image_hash"])
        assert sorted(x["id"] for x in got.collect()) == sorted(x["id"] for x in rows.where(F.col("image_hash") == r["image_hash"]).collect())
        assert len(got.inputFiles()) == 1
    every = held.candidates(rows).select("image_hash").distinct().count()
    assert every == rows.where("image_hash is not null").select("image_hash").distinct().count()


def test_absent_keys_open_nothing(spark, kept):
    rows, held = kept
    absent = spark.range(2000).select(F.sha2(F.concat(F.lit("absent"), "id"), 256).alias("image_hash"))
    told = held.candidates(absent).count()
    assert told <= 2000 * 0.03
    clean = absent.join(held.candidates(absent), "image_hash", "left_anti").first()["image_hash"]
    got = held.lookup(clean)
    assert got.count() == 0 and not got.inputFiles()
    assert held.lookup(None).count() == 0


def test_batches(spark, kept):
    rows, held = kept
    batch = rows.where("id % 5 = 0").select("image_hash", F.lit(1).alias("n")).union(spark.range(50).select(F.sha2(F.concat(F.lit("other"), "id"), 256), F.lit(2)))
    batch = batch.union(spark.createDataFrame([(None, 3)], "image_hash string, n int"))
    known, new = held.known(batch).collect(), held.new(batch).collect()
    assert all(r["n"] == 1 and r["image_hash"] for r in known) and len(known) == batch.where("n = 1 and image_hash is not null").count()
    assert len(known) + len(new) == batch.count()


def test_numbers_and_empty(spark, tmp_path):
    held = Skipping(spark, str(tmp_path / "numbers"), "id")
    held.store(spark.range(0, 3000, 3), 250)
    assert held.lookup(2997).count() == 1 and len(held.lookup(2997).inputFiles()) == 1
    assert held.lookup(10**12).count() == 0 and held.files(spark.createDataFrame([(-5,)], "id long")) == []
    none = Skipping(spark, str(tmp_path / "empty"), "id")
    none.store(spark.range(0))
    assert none.lookup(3).count() == 0 and none.new(spark.range(4)).count() == 4


def test_one_key_in_many_files(spark, tmp_path):
    """A third of the rows has one key and fills several files, the first and last of which hold others too."""
    rows = spark.range(0, 900).select(F.when(F.col("id") % 3 == 0, 450).otherwise(F.col("id")).alias("id"), F.col("id").alias("n"))
    held = Skipping(spark, str(tmp_path / "hot"), "id")
    held.store(rows, 70)
    assert held.candidates(spark.createDataFrame([(450,)], "id long")).count() >= 4
    assert sorted(r["n"] for r in held.lookup(450).collect()) == list(range(0, 900, 3))
    assert held.known(rows).count() == 900 and held.new(rows).count() == 0


def test_a_batch_is_told_at_once(spark, kept, monkeypatch):
    """Known and new rows by one choice of files; repeated keys of table or batch multiply nothing."""
    rows, held = kept
    chosen, files = [], Skipping.files
    monkeypatch.setattr(Skipping, "files", lambda self, keys: chosen.append(1) or files(self, keys))
    batch = rows.where("id % 5 = 0").select("image_hash", "id").union(spark.range(50).select(F.sha2(F.concat(F.lit("other"), "id"), 256), "id")).union(spark.createDataFrame([(None, 3)], "image_hash string, id long"))
    told = held.told(batch.union(batch))
    assert told.columns == ["image_hash", "id", "known"] and len(chosen) == 1
    known = batch.join(rows.select("image_hash").distinct(), "image_hash", "left_semi").count()
    assert told.where("known").count() == 2 * known and told.where("not known").count() == 2 * (batch.count() - known)
