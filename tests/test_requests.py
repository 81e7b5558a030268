"""The request path as a stream: copies, late fields, corrections, orphans, and a restart in the middle of a batch."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallymill.streaming import requests

BASE = {"acno": "000123456789", "ifsc": "CNRB0123456", "date": "05/01/2026", "amount": "5000", "name": "Payee", "signature": "yes"}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def at(day, hour=0):
    return datetime.datetime(2026, 1, day, hour)


def landing(image, number, when, amount=5000.0, **other):
    return [(image, "extraction", number, number, when, amount, f, v, 0.9) for f, v in {**BASE, **other}.items()]


@pytest.fixture
def path(spark, tmp_path):
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield lambda name: str(tmp_path / name)
    for k, v in before.items():
        spark.conf.set(k, v)


def run(spark, path, rows, **waits):
    if rows:
        spark.createDataFrame(rows, requests.REQUEST).coalesce(1).write.mode("append").parquet(path("in"))
    stream = spark.readStream.schema(requests.REQUEST).parquet(path("in"))
    requests.start(stream, path("out"), path("state"), F.to_date(F.lit("2026-01-10")), **waits).awaitTermination()


def test_a_restart_within_a_batch(spark, path, monkeypatch):
    """The first try of the second batch fails between its tables; what comes out is as if it had not."""
    run(spark, path, landing("a", 1, at(1, 1)) + landing("a", 2, at(1, 2)) + landing("b", 3, at(1, 1)) + [("b", "field", 4, None, at(1), None, "amount", "abc", 0.9)])
    second = [("b", "correction", 5, None, at(1, 3), None, "amount", "700", 1.0)] + landing("b", 6, at(1, 4)) + landing("c", 7, at(1, 4), 1e6)
    signals = requests.signals_by
    monkeypatch.setattr(requests, "signals_by", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        run(spark, path, second)
    monkeypatch.setattr(requests, "signals_by", signals)
    run(spark, path, [])
    read = lambda name: spark.read.parquet(path(f"out/{name}"))
    documents = sorted((r["doc_id"], r["version"], r["status"], r["amount"]) for r in read("documents").collect())
    assert documents == [(1, 1, "VERIFIED", 5000.0), (3, 1, "INVALID", 5000.0), (3, 2, "VERIFIED", 5000.0), (7, 1, "VERIFIED", 1e6)]
    assert {r["doc_id"]: r["status"] for r in requests.latest(read("documents")).collect()} == {1: "VERIFIED", 3: "VERIFIED", 7: "VERIFIED"}
    amounts = {(r["doc_id"], r["version"]): (r["value"], r["confidence"], r["method"]) for r in read("fields").where("field_name = 'amount'").collect()}
    assert amounts == {(1, 1): ("5000", 0.9, "ocr"), (3, 1): ("abc", 0.9, "recognizer"), (3, 2): ("700", 1.0, "manual_correction"), (7, 1): ("5000", 0.9, "ocr")}
    audit = sorted((r["resource_id"], r["action"], r["details"].get("old_status"), r["details"].get("copies")) for r in read("audit").collect())
    assert audit == [("1", "COPY_DROPPED", None, "1"), ("1", "STATUS_CHANGE", "LANDED", None), ("3", "COPY_DROPPED", None, "1"), ("3", "STATUS_CHANGE", "INVALID", None), ("3", "STATUS_CHANGE", "LANDED", None), ("7", "STATUS_CHANGE", "LANDED", None)]
    assert read("totals").orderBy(F.desc("batch")).first()["n"] == 3
    assert read("checks").where("doc_id = 3 and version = 1").first()["validation_reason"] == "[AMOUNT] Amount 'abc' is not a valid numeric value"


def test_timers(spark, path):
    """A field whose document does not come is told as an orphan; a document is forgotten after its retention, so a copy is new."""
    waits = {"patience": "1 day", "retention": "3 days", "lateness": "1 hour"}
    first = [("x", "field", 1, None, at(1), None, "amount", "5", 0.9), *landing("a", 2, at(1)), *landing("b", 3, at(3)), *landing("a", 4, at(3))]
    run(spark, path, first, **waits)
    run(spark, path, landing("c", 5, at(9)), **waits)
    run(spark, path, landing("a", 6, at(9, 1)), **waits)
    told = sorted((r["image_hash"], r["event"], r["doc_id"], r["copies"]) for r in spark.read.parquet(path("out/changes")).collect() if r["event"] != "orphan")
    assert told == [("a", "landed", 2, 1), ("a", "landed", 6, 0), ("b", "landed", 3, 0), ("c", "landed", 5, 0)]
    assert [r["image_hash"] for r in spark.read.parquet(path("out/changes")).where("event = 'orphan'").collect()] == ["x"]
