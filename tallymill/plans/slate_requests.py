"""The request path as a stream over the driver's events, held against SQL over the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import shared_folder
from ..streaming import requests
from .slate import ORACLES, QUERIES
from .slate_fields import ERRORS, FIELDS, WARNINGS

#: What an event says as a request; Spark and DuckDB read it alike. An event lands a document with six fields, or tells one field.
VALUES = {
    "acno": "CASE e % 7 WHEN 0 THEN '12345' WHEN 1 THEN '12A456789' ELSE lpad(CAST(e AS STRING), 12, '0') END",
    "ifsc": "CASE e % 11 WHEN 0 THEN 'SBIN001' WHEN 1 THEN 'CNRBO123456' ELSE concat('CNRB0', lpad(CAST(e % 1000000 AS STRING), 6, '0')) END",
    "date": "CASE e % 13 WHEN 0 THEN '30/02/2000' WHEN 1 THEN '2000' ELSE concat(lpad(CAST(e % 28 + 1 AS STRING), 2, '0'), '/', lpad(CAST(e % 12 + 1 AS STRING), 2, '0'), '/', CAST(2000 + e % 2 AS STRING)) END",
    "amount": "CASE e % 17 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN 'abc' ELSE CAST(e * 7 + 1 AS STRING) END",
    "name": "CASE e % 19 WHEN 0 THEN 'A' WHEN 1 THEN 'CASH' ELSE 'Payee' END",
    "signature": "CASE e % 23 WHEN 0 THEN '' ELSE 'yes' END",
}
KIND = "CASE event_type WHEN 'signup' THEN 'extraction' WHEN 'purchase' THEN 'extraction' WHEN 'error' THEN 'correction' ELSE 'field' END"
AMOUNT = "CAST(CASE event_id % 50 WHEN 0 THEN 20000 WHEN 1 THEN 10000 ELSE 1000 * (1 + event_id % 5) END AS DOUBLE)"
CONFIDENCE = "CASE kind WHEN 'correction' THEN 1.0 WHEN 'field' THEN CASE e % 4 WHEN 0 THEN 0.5 ELSE 0.9 END ELSE 0.9 END"


def requests_of(events: DataFrame) -> DataFrame:
    rows = events.selectExpr("sha2(concat(user_id, '-', event_id % 3), 256) AS image_hash", f"{KIND} AS kind", "event_id AS e", "event_id AS request_id", "event_id AS doc_id", "ts", f"{AMOUNT} AS amount")
    told = F.array(*[F.struct(F.lit(k).alias("field_name"), F.expr(v).alias("value")) for k, v in VALUES.items()])
    which = F.when(F.col("kind") == "extraction", told).otherwise(F.array(F.get(told, (F.col("e") % 6).cast("int"))))
    rows = rows.select("*", F.inline(which))
    return rows.select("image_hash", "kind", "request_id", "doc_id", "ts", "amount", "field_name", "value", F.expr(CONFIDENCE).cast("double").alias("confidence"))


def streamed(spark: SparkSession, sf_dir: str) -> str:
    """Streams all events through the request path; the folder with what it wrote."""
    folder = f"{shared_folder(spark)}/requests-{uuid.uuid4().hex}"
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    # a file or a folder of parts
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{sf_dir}/events.parquet*")
    history = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(f"{AMOUNT} AS amount")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        requests.start(requests_of(events), folder, f"{folder}/state", F.to_date(F.lit("2001-01-01")), history, patience="60 days", retention="60 days").awaitTermination()
    finally:
        spark.conf.set(key, before)
    return folder


def ingest_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document that landed: its status and priority, its fields, its checks, its copies and its signal."""
    folder = streamed(spark, sf_dir)
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    documents = requests.latest(read("documents"))
    last = documents.select("doc_id", "version")
    row = lambda df, what, name, value: df.select("doc_id", F.lit(what).alias("what"), name.alias("name"), value.alias("value"))
    copies = read("changes").where("doc_id is not null").groupBy("doc_id").agg(F.sum("copies").alias("n"))
    parts = [
        row(documents, "status", F.col("status"), F.col("priority")),
        row(documents, "confidence", F.lit("overall"), F.format_string("%.4f", "overall_confidence")),
        row(read("fields").join(last, ["doc_id", "version"]), "field", F.col("field_name"), F.concat_ws("|", "value", "method")),
        row(read("checks").join(last, ["doc_id", "version"]), "check", F.concat_ws("|", "check_type", "validation_status", "review_priority", "review_resolution"), F.col("validation_reason")),
        row(copies, "copies", F.lit("n"), F.col("n").cast("string")),
        row(read("signals"), "signal", F.col("signal_type"), F.col("severity")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


LOW = "CASE WHEN {f}_conf < 0.6 THEN ['Composite confidence ' || format('{{:.2f}}', {f}_conf) || ' falls below threshold 0.60'] ELSE [] END"
_parts = [f"list_transform(list_concat(list_concat({ERRORS[f]}, {WARNINGS.get(f, '[]')}), {LOW.format(f=f)}), lambda r: '[{f.upper()}] ' || r)" for f in FIELDS]
_parts += [
    "CASE WHEN amount = '' THEN ['Mandatory field ''amount'' has empty value'] ELSE [] END",
    "CASE WHEN signature = '' THEN ['Signature unconfirmed in designated signatory area (confidence: ' || format('{:.2f}', signature_conf) || ')', '[CONSISTENCY] Signature mark not detected with sufficient confidence (' || format('{:.2f}', signature_conf) || ' < 0.50)'] ELSE [] END",
]
_reasons = _parts[0]
for _p in _parts[1:]:
    _reasons = f"list_concat({_reasons}, {_p})"
_fatal = " + ".join(f"len({ERRORS[f]})" for f in FIELDS) + " + CASE WHEN amount = '' THEN 1 ELSE 0 END + CASE WHEN signature = '' THEN 1 ELSE 0 END"
_told = " UNION ALL ".join(f"SELECT *, '{k}' AS field_name, {v} AS value FROM r WHERE kind = 'extraction' OR e % 6 = {i}" for i, (k, v) in enumerate(VALUES.items()))
_pivot = ", ".join(f"max(value) FILTER (field_name = '{f}') AS {f}, max(confidence) FILTER (field_name = '{f}') AS {f}_conf" for f in VALUES)
REQUESTS_SQL = f"""
WITH r AS MATERIALIZED (SELECT user_id || '-' || event_id % 3 AS h, {KIND} AS kind, event_id AS e, ts, {AMOUNT} AS amount FROM events),
told AS (SELECT h, kind, e, ts, field_name, value, CAST({CONFIDENCE} AS DOUBLE) AS confidence FROM ({_told})),
docs AS MATERIALIZED (SELECT h, e AS doc_id, amount FROM r WHERE kind = 'extraction' QUALIFY row_number() OVER (PARTITION BY h ORDER BY ts, e) = 1),
counted AS (SELECT told.*, doc_id FROM told JOIN docs USING (h) WHERE kind <> 'extraction' OR e = doc_id),
last AS MATERIALIZED (SELECT doc_id, field_name, value, confidence, CASE kind WHEN 'extraction' THEN 'ocr' WHEN 'field' THEN 'recognizer' ELSE 'manual_correction' END AS method FROM counted
  QUALIFY row_number() OVER (PARTITION BY doc_id, field_name ORDER BY CASE kind WHEN 'extraction' THEN 0 WHEN 'field' THEN 1 ELSE 2 END DESC, ts DESC, e DESC) = 1),
w AS (SELECT doc_id, round(avg(confidence), 4) AS conf, {_pivot} FROM last GROUP BY doc_id),
j AS (SELECT *, {_reasons} AS reasons, {_fatal} AS n_fatal FROM w),
s AS (SELECT *, CASE WHEN n_fatal > 0 THEN 'INVALID' WHEN len(reasons) > 0 THEN 'REVIEW_REQUIRED' WHEN conf >= 0.8 THEN 'VERIFIED' ELSE 'PROCESSED' END AS status FROM j),
t AS MATERIALIZED (SELECT *, CASE WHEN status = 'INVALID' THEN 'HIGH' WHEN status = 'REVIEW_REQUIRED' THEN CASE WHEN coalesce(TRY_CAST(amount AS DOUBLE), 0) >= 50000 OR len(reasons) >= 3 THEN 'HIGH' ELSE 'MEDIUM' END ELSE 'LOW' END AS priority FROM s),
stats AS (SELECT avg({AMOUNT}) AS mean, stddev_pop({AMOUNT}) AS std, quantile_disc({AMOUNT}, 0.25) AS q1, quantile_disc({AMOUNT}, 0.75) AS q3 FROM events)
SELECT doc_id, 'status' AS what, status AS name, priority AS value FROM t
UNION ALL SELECT doc_id, 'confidence', 'overall', format('{{:.4f}}', conf) FROM t
UNION ALL SELECT doc_id, 'field', field_name, value || '|' || method FROM last
UNION ALL SELECT doc_id, 'check', CASE WHEN len(reasons) = 0 THEN 'ALL_GATES|VALID|LOW|ACCEPTED' ELSE 'COMPLIANCE_GATE|' || CASE status WHEN 'REVIEW_REQUIRED' THEN 'WARNING' ELSE 'INVALID' END || '|' || priority || '|PENDING' END,
    unnest(CASE WHEN len(reasons) > 0 THEN reasons WHEN status = 'VERIFIED' THEN ['All field formats, confidence gates, and consistency checks passed successfully'] ELSE [] END) FROM t
UNION ALL SELECT doc_id, 'copies', 'n', CAST(count(*) - 1 AS VARCHAR) FROM docs JOIN r USING (h) WHERE kind = 'extraction' GROUP BY doc_id
UNION ALL SELECT doc_id, 'signal', 'AMOUNT_OUTLIER_REVIEW_SIGNAL', CASE WHEN (amount - mean) / std >= 4 OR amount > q3 + 4 * (q3 - q1) THEN 'HIGH' ELSE 'MEDIUM' END FROM docs, stats
    WHERE (amount > q3 + 2.5 * (q3 - q1) AND q3 > q1) OR (amount - mean) / std >= 3"""

QUERIES["ingest_requests"] = ingest_requests
ORACLES["ingest_requests"] = REQUESTS_SQL
