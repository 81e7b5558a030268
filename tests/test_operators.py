"""Operators on a small seeded set of documents, with figures worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallymill import schemas, session
from tallymill.operators import datasets, evaluate, kpi, ledger, mutate, review, tokens, trends
from tallymill.sources import scans, sinks
from tallymill.streaming import ingest

START = datetime.datetime(2026, 9, 20, 10)
AMOUNTS = [10000, 12000, 14000, 15000, 24500, 16000, 17000, 18000, 19000, 26500, 20000, 21000, 22000, 23000, 18000]


@pytest.fixture(scope="module")
def seed(spark):
    docs, fields, checks, runs = [], [], [], []
    for i in range(20):
        at = START + datetime.timedelta(days=i // 5, hours=i % 5)
        flagged = i % 4 == 0
        docs.append((i + 1, "REVIEW_REQUIRED" if flagged else "VERIFIED" if i % 2 == 0 else "PROCESSED", 0.75 + 0.01 * i, flagged, at))
        runs.append((i + 1, i + 1, at, 120.0 + 5 * i))
        checks.append((i + 1, i + 1, "DATE_VALIDITY" if flagged else "ALL_GATES", "INVALID" if flagged else "VALID", not flagged, "stale" if flagged else "fine"))
        if i < 15:
            fields.append((2 * i + 1, i + 1, "amount", f"₹{AMOUNTS[i]:,}", 0.92))
        fields.append((2 * i + 2, i + 1, "cheque_number", str(100000 + i), 0.96))
    return {
        "docs": spark.createDataFrame(docs, "id long, status string, overall_confidence double, review_required boolean, created_at timestamp"),
        "fields": spark.createDataFrame(fields, "id long, cheque_id long, field_name string, normalized_value string, confidence double"),
        "checks": spark.createDataFrame(checks, "id long, cheque_id long, check_type string, validation_status string, is_valid boolean, validation_reason string"),
        "runs": spark.createDataFrame(runs, "id long, cheque_id long, run_timestamp timestamp, total_latency_ms double"),
    }


def test_counts(seed):
    v = kpi.volume(seed["docs"]).first()
    assert (v["total"], v["review_required"], v["verified"], v["processed"]) == (20, 5, 5, 10)
    r = kpi.review_stats(seed["docs"]).first()
    assert (r["flagged"], r["auto_cleared"], r["review_rate"], r["mean_confidence"]) == (5, 15, 25.0, 0.845)
    h = kpi.confidence_histogram(seed["docs"], "overall_confidence").first()
    assert [h[f"bucket_{i}"] for i in range(5)] == [0, 0, 10, 10, 0] and h["std"] == 0.0577
    assert kpi.total(seed["docs"].where("id < 0")).first()["total"] == 0
    assert kpi.review_stats(seed["docs"].where("id < 0")).first()["review_rate"] == 0


def test_amounts_and_latency(seed):
    a = kpi.amount_stats(seed["fields"].where("field_name = 'amount'"), "normalized_value").first()
    assert (a["n"], a["sum"], a["mean"], a["median"]) == (15, 276000.0, 18400.0, 18000.0)
    x = kpi.latency_stats(seed["runs"]).first()
    assert (x["mean"], x["p50"], x["p90"], x["p99"], x["min"], x["max"]) == (167.5, 165.0, 205.0, 215.0, 120.0, 215.0)
    assert kpi.latency_interpolated(seed["runs"]).first()["p50"] == 167.5
    assert kpi.sla(seed["runs"], seed["docs"], 300, 30).first()["met"]


def test_trends(seed):
    days = trends.volume_trend(seed["docs"], "day").collect()
    assert [(d["total"], round(d["mean_confidence"], 2)) for d in days] == [(5, 0.77), (5, 0.82), (5, 0.87), (5, 0.92)]
    assert [r["sum"] for r in trends.amount_trend(seed["docs"], seed["fields"].where("field_name = 'amount'")).collect()] == [75500.0, 96500.0, 104000.0]
    assert trends.volume_trend(seed["docs"], "week").first()["period"].endswith("(W37)")


def test_signals(spark, seed):
    history = seed["fields"].where("field_name = 'amount'").select(F.regexp_replace("normalized_value", "[^0-9]", "").cast("double").alias("amount"))
    got = trends.amount_signals(spark.createDataFrame([(18000.0,), (500000.0,)], "amount double"), history).collect()
    assert [(r["amount"], r["severity"], r["is_fraud_claim"]) for r in got] == [(500000.0, "HIGH", False)]
    assert not trends.amount_signals(history, history.limit(5)).count()
    late = trends.latency_signals(spark.createDataFrame([(150.0,), (800.0,)], "total_latency_ms double"), seed["runs"]).collect()
    assert [(r["severity"], r["anomaly_score"]) for r in late] == [("MEDIUM", 21.94)]


def test_ledger(seed):
    rows = ledger.ledger(seed["docs"], seed["fields"], 3).collect()
    assert sorted(r["id"] for r in rows) == [18, 19, 20] and all(r["amount"] == "" for r in rows)
    nested = ledger.nested(seed["docs"].select("id"), fields=seed["fields"].where("cheque_id < 3")).where("id in (1, 9)").orderBy("id").collect()
    assert [len(r["fields"]) for r in nested] == [2, 0]
    assert ledger.field_map(seed["fields"]).where("cheque_id = 1").first()["fields"]["cheque_number"]["value"] == "100000"


def test_fuse(spark):
    d = spark.createDataFrame([(1, "ifsc", 0.99), (1, "amount", 0.9), (2, "date", 0.9)], "doc_id long, field_name string, detection_confidence double")
    o = spark.createDataFrame([(1, "ifsc", "HDFC0001234", "HDFCO001234", 0.96, "HIGH", True), (1, "amount", "", "?", 0.2, "LOW", False)], "doc_id long, field_name string, text string, raw_text string, confidence double, tier string, valid boolean")
    r = spark.createDataFrame([(1, "amount", "4720", 0.85, True)], "doc_id long, field_name string, text string, confidence double, success boolean")
    got = {(x["doc_id"], x["field_name"]): x for x in review.fuse(d, o, r).collect()}
    assert got[1, "ifsc"]["method"] == "ocr" and got[1, "ifsc"]["confidence"] > 0.9
    assert (got[1, "amount"]["method"], got[1, "amount"]["value"], got[1, "amount"]["confidence_tier"]) == ("recognizer", "4720", "HIGH")
    assert (got[2, "date"]["method"], got[2, "date"]["confidence"]) == ("none", 0.0)
    filled = review.fill_missing(review.fuse(d, o, r), spark.range(1, 3).withColumnRenamed("id", "doc_id"))
    assert filled.count() == 10


def wide(spark, **change):
    row = {"doc_id": 1, "acno": "00140100021389", "ifsc": "CNRB0002854", "date": "15/05/2022", "amount": "4720.50", "name": "Ethel M. Bryson", "amt_in_words": None, "bank_name": None, "signature_present": True, "signature_confidence": 0.9, "overall_confidence": 0.9, **{f"{f}_confidence": 0.95 for f in schemas.CORE_FIELDS}} | change
    kinds = {"doc_id": "long", "signature_present": "boolean"} | {k: "double" for k in row if k.endswith("confidence")}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in row))


@pytest.mark.parametrize(("change", "status", "priority"), [({}, "VERIFIED", "LOW"), ({"overall_confidence": 0.7}, "PROCESSED", "LOW"), ({"date": "01/01/2022", "acno_confidence": 0.45}, "REVIEW_REQUIRED", "MEDIUM"), ({"date": "01/01/2022", "amount": "60000"}, "REVIEW_REQUIRED", "HIGH"), ({"acno": "12", "amount": "0.00"}, "INVALID", "HIGH"), ({"signature_present": False}, "INVALID", "HIGH"), ({"amt_in_words": "five thousand"}, "INVALID", "HIGH"), ({"bank_name": "Axis Bank"}, "REVIEW_REQUIRED", "MEDIUM")])
def test_triage(spark, change, status, priority):
    got = review.triage(wide(spark, **change), F.lit(datetime.date(2022, 6, 1))).first()
    assert (got["status"], got["priority"]) == (status, priority), got["reasons"]
    assert not any("fraud" in r for r in got["reasons"])
    rows = review.validation_rows(review.triage(wide(spark, **change), F.lit(datetime.date(2022, 6, 1)))).count()
    assert rows == {"VERIFIED": 1, "PROCESSED": 0}.get(status, len(got["reasons"]))


def test_mutations(spark, seed):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, x string, y int")
    got = mutate.upsert(base, spark.createDataFrame([(2, "c"), (3, "d")], "id long, x string"), ["id"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a", 1), (2, "c", 2), (3, "d", None)]
    gone = spark.createDataFrame([(1,)], "id long")
    (left,) = mutate.cascade_delete(gone, (seed["fields"], "cheque_id"))
    assert left.count() == seed["fields"].count() - 2
    assert mutate.set_null(seed["runs"], gone, "cheque_id").where("cheque_id is null").count() == 1
    assert mutate.orphans(seed["runs"], "cheque_id", seed["docs"].where("id > 1")).count() == 1


def test_datasets(spark, tmp_path):
    rows = [(i, f"h{i % 7}", "train" if i % 2 else "val", i) for i in range(20)] + [(99, "", "val", 99), (98, None, "train", 98)]
    s = spark.createDataFrame(rows, "sample_id long, image_hash string, split string, ordinal long")
    assert datasets.duplicate_groups(s).count() == 7
    assert datasets.duplicate_summary(s).first()["instances"] == 13
    assert not datasets.duplicate_flags(s).where("sample_id in (98, 99)").where("is_duplicate").count()
    assert {r["pair"] for r in datasets.leakage(s, F.when(F.col("split") == "train", 0).otherwise(1)).collect()} == {"train_val_leakage"}
    split = datasets.leak_free_split(spark.range(72).select(F.concat(F.lit("x"), "id").alias("image_hash")))
    assert dict(split.groupBy("split").count().collect()) == {"train": 52, "val": 10, "test": 10}
    sinks.flat_csv(s.select("sample_id", F.array("image_hash").alias("labels")), str(tmp_path / "csv"))
    assert scans.manifest_csv(spark, str(tmp_path / "csv"), "sample_id long, labels string").count() == 22


def test_detection(spark):
    box = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    p = spark.createDataFrame([(1, 1, 0, 0.9, (0.0, 0.0, 10.0, 10.0))], f"image_id long, class_id int, pred_id long, score double, box {box}")
    t = spark.createDataFrame([(1, 1, 0, (0.0, 0.0, 10.0, 10.0)), (1, 2, 1, (0.0, 0.0, 5.0, 5.0))], f"image_id long, class_id int, truth_id long, box {box}")
    hit = evaluate.hits(evaluate.matches(p, t), [0.5])
    m = {r["class_id"]: r for r in evaluate.detection_metrics(hit, t).collect()}
    assert (m[1]["precision"], m[1]["recall"], m[1]["tp"], m[2]["recall"]) == (1.0, 1.0, 1, 0.0)
    assert {r["class_id"]: r["ap"] for r in evaluate.average_precision(hit, t, [0.5]).collect()} == {1: 1.0, 2: 0.0}


def test_classes(spark):
    rows = [(i, {1: 4, 7: 1}.get(i, i), 0.5 if i in (2, 3) else 0.9) for i in range(10)]
    pairs = spark.createDataFrame(rows, "truth int, predicted int, confidence double")
    matrix = evaluate.confusion_matrix(pairs, 10)
    assert matrix.count() == 100 and evaluate.confusing_pairs(matrix).count() == 2
    assert evaluate.macro_metrics(pairs, evaluate.class_metrics(matrix)).first()["accuracy"] == 0.8
    assert evaluate.error_cases(pairs).count() == 4


def test_tokens(spark):
    b = spark.createDataFrame([(1, 10, 5), (1, 12, 5), (1, 0, 5), (1, 20, 5)], "field_id long, x int, w int")
    kept = tokens.deoverlapped(b)
    assert [k["x"] for k in kept.first()["kept"]] == [0, 10, 20]
    assert [r["sign"] for r in tokens.paired_glyphs(kept.withColumn("label", F.lit("147"))).orderBy("position").collect()] == ["1", "4", "7"]


def test_scans(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t2\t9\t0\t5\t5\t96.5\tb\n5\t1\t1\t1\t1\t1\t0\t0\t5\t5\t-1\ta\n5\t1\t1\t1\t1\t3\t0\t0\t5\t5\t50\t \n4\t1\t1\t1\t1\t3\t0\t0\t5\t5\t50\tx\n")
    words = scans.ocr_tokens(spark, str(tmp_path / "x.tsv")).withColumn("field_id", F.lit(1))
    got = tokens.token_rollup(words).first()
    assert (got["text"], got["tokens"], got["min_confidence"]) == ("a b", 2, 0.0)
    (tmp_path / "Scan 1.tif").write_bytes(b"x")
    assert scans.image_files(spark, str(tmp_path), "*.tif").first()["sample_id"] == "scan_1"
    (tmp_path / "split.json").write_text('{"train": ["a", "b"], "val": ["c"]}')
    assert scans.split_mapping(spark, str(tmp_path / "split.json")).count() == 3
    told = scans.prompted_rows(spark.createDataFrame([("Read it", "{'a': '1'}"), ("the CHEQUE date", "plain")], "query string, answer string"), "Read it", "cheque|payee").collect()
    assert [(r["category"], r["ground_truth"]) for r in told] == [("handwriting", {"a": "1"}), ("document", {"raw_text": "plain"})]


LANDED = "name string, length long, width int, height int, image_hash string, created_at timestamp, amount double"


def landed_rows(at, amounts, mark):
    return [(f"{mark}{i}.tif", 1000, 800, 400, f"{mark}{i}", at, a) for i, a in enumerate(amounts)]


def test_stream(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    path = lambda name: str(tmp_path / name)

    def land(rows, history=None):
        spark.createDataFrame(rows, LANDED).coalesce(1).write.mode("append").parquet(path("in"))
        stream = ingest.gated(ingest.landing(spark, path("in"), LANDED))
        ingest.start(stream, path("docs"), path("signals"), path("totals"), path("ck"), history).awaitTermination()

    first = [100.0 + i for i in range(15)]
    copies = landed_rows(at, first, "a")
    land(copies + copies[:7] + [("x.exe", 1, 800, 400, "bad", at, 1.0), ("n.tif", 1000, 800, 400, "none", at, None)])
    assert spark.read.parquet(path("docs")).count() == 16
    # nothing came before the first batch, so nothing in it stands out
    assert spark.read.parquet(path("signals")).count() == 0
    land(landed_rows(at, [1e6, 107.0], "b"))
    told = spark.read.parquet(path("signals")).collect()
    assert [(r["name"], r["severity"], r["mean"], r["std"], r["q1"], r["q3"]) for r in told] == [("b0.tif", "HIGH", 107.0, 4.32, 103.0, 111.0)]
    land(landed_rows(at, [1e5], "c"))
    last = spark.read.parquet(path("totals")).orderBy(F.desc("batch")).first()
    values = [*first, 1e6, 107.0, 1e5]
    mean = sum(values) / len(values)
    assert last["n"] == len(values) and last["mean"] == pytest.approx(mean)
    assert last["deviations"] == pytest.approx(sum((v - mean) ** 2 for v in values))


def test_stream_with_a_history(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    spark.createDataFrame(landed_rows(at, [5e5, 105.0], "a"), LANDED).write.parquet(str(tmp_path / "in"))
    past = spark.createDataFrame([(100.0 + i,) for i in range(15)], "amount double")
    stream = ingest.gated(ingest.landing(spark, str(tmp_path / "in"), LANDED))
    ingest.start(stream, *(str(tmp_path / n) for n in ("docs", "signals", "totals", "ck")), past).awaitTermination()
    assert [r["name"] for r in spark.read.parquet(str(tmp_path / "signals")).collect()] == ["a0.tif"]


def test_schemas(spark):
    for name in schemas.TABLES:
        assert schemas.conform(spark.range(1), name).schema == schemas.schema(name) or schemas.conform(spark.range(1), name).columns == schemas.schema(name).names
    assert schemas.conform(spark.range(1), "documents").first()["status"] == "PROCESSED"


def test_report(seed):
    fields = seed["fields"].select("*", F.lit(0.9).alias("detection_confidence"), F.lit(0.9).alias("extraction_confidence"), F.lit("ocr").alias("extraction_method"), F.lit("HIGH").alias("confidence_tier"))
    amounts = seed["fields"].where("field_name = 'amount'")
    told = sinks.executive_markdown(kpi.executive_record(seed["docs"], amounts, fields, seed["checks"], seed["runs"]), "2026-01-01")
    assert [x for x in told.splitlines() if x.startswith("## ")] == [f"## {i}. {t}" for i, t in enumerate(("Headline figures", "Statuses", "Amounts", "Confidences", "Fields", "Checks", "Notice"), 1)]
    assert sum(": met |" in x or ": missed |" in x for x in told.splitlines()) == 5
    assert sum(x.startswith("- ") and "%)" in x for x in told.splitlines()) == seed["docs"].select("status").distinct().count()


def test_schema_rules(spark):
    """Each kind of rule of each table is broken once."""
    for name in schemas.TABLES:
        rules = schemas.rules(name)
        # a table of nulls breaks the null rules and no other
        row = spark.createDataFrame([tuple([None] * len(schemas.schema(name)))], schemas.schema(name))
        assert set(datasets.violations(row, rules).first()["violations"]) == {r for r in rules if r.endswith("_null")}
    users = spark.createDataFrame([(1, "ab", "a@b", "x", "KING", True, None, None)], schemas.schema("users"))
    assert datasets.violations(users, schemas.rules("users", ["username", "email", "role"])).first()["violations"] == ["username_length", "email_length", "role_word"]
    runs = spark.createDataFrame([("DONE", -1.0)], "status string, total_latency_ms double")
    assert datasets.violations(runs, schemas.rules("processing_runs", runs.columns)).first()["violations"] == ["status_word", "total_latency_ms_least"]


def test_literal_answers(spark):
    rows = [("Read it", "{'a': None, 'b': True, 'c': {'d': [1, 2]}, 'e': 'x'}"), ("Read it", "{'a': "), ("the CHEQUE date", "[1]"), ("else", None)]
    told = scans.prompted_rows(spark.createDataFrame(rows, "query string, answer string"), "Read it", "cheque|payee")
    assert [(r["category"], r["ground_truth"]) for r in told.collect()] == [
        ("handwriting", {"a": None, "b": "true", "c": '{"d": [1, 2]}', "e": "x"}), ("handwriting", {"raw_text": "{'a': "}), ("document", {"raw_text": "[1]"}), ("other", {"raw_text": None}),
    ]
    assert scans.prompted_rows(spark.createDataFrame(rows, "query string, answer string"), "Read it", "cheque|payee", category="document").count() == 1


def test_splits_that_are_absent(spark, tmp_path):
    path = str(tmp_path / "train.parquet")
    spark.range(2).selectExpr("named_struct('bytes', CASE WHEN id = 0 THEN CAST('x' AS BINARY) END) AS image", "named_struct('xmin', 1, 'ymin', 2, 'xmax', 3, 'ymax', 4) AS amount").write.parquet(path)
    rows = scans.labelled_images(spark, {"train": path, "val": str(tmp_path / "none.parquet")}, ("amount",)).collect()
    assert [(r["source_split"], r["annotations"]["amount"]["xmax"], r["fault"]) for r in rows] == [("train", 3, "unknown format")]
    assert scans.labelled_images(spark, {}, ("amount",)).count() == 0


def test_search_by_two_terms(spark):
    """A value's term is not looked for in identifiers, nor the identifier's in values; without one both have the same term."""
    documents = spark.createDataFrame([(1, "CHQ-771"), (2, "CHQ-8812"), (3, "CHQ-3"), (4, "CHQ-4"), (5, None)], "id long, cheque_identifier string")
    fields = spark.createDataFrame([(3, "x8812"), (3, "88123"), (4, "a-77"), (5, "8812"), (1, None)], "cheque_id long, normalized_value string")
    ids = lambda *a, **k: sorted(r["id"] for r in ledger.search(documents, fields, *a, **k).collect())
    assert ids("-77", field_term="8812") == [1, 3, 5]
    assert ids("8812") == [2, 3, 5]


def test_repeated_keys_by_task(spark, monkeypatch):
    """Keys meet in as many tasks as they need, and no task holds those of its own part of the table before that."""
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    rows = spark.range(0, 1000, 1, 2).select((F.col("id") % 995).alias("key"), "id")
    twice = mutate.duplicates_of_key(rows, "key")
    assert sorted((r["key"], r["n"]) for r in twice.collect()) == [(k, 2) for k in range(5)]
    plan = twice._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan and "10)" in plan
    monkeypatch.setattr(session, "ROWS_A_TASK", 1000)
    assert "REPARTITION_BY_NUM" not in mutate.duplicates_of_key(rows, "key")._jdf.queryExecution().executedPlan().toString()
