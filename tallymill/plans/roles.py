"""The driver's tables in the roles of the clearing tables. The texts are SQL that Spark and DuckDB read alike; derived columns
are integer arithmetic on keys, and fractions are binary ones, so both see the same values whatever the order of a sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TIER = "CASE WHEN {c} >= 0.8 THEN 'HIGH' WHEN {c} >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END"
#: One id for each line; lines that are equal in all their keys are equal in every derived column.
LINE = "(l_orderkey * 10000000000 + CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey)"
LINE_CONF = "(CAST((l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 129 AS DOUBLE) / 128)"

ROLES = {
    "documents_": """SELECT o_orderkey AS id, 'CHQ-' || CAST(o_orderkey AS STRING) AS cheque_identifier,
        CASE o_orderstatus WHEN 'O' THEN 'PROCESSED' WHEN 'F' THEN 'VERIFIED' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'INVALID' ELSE 'REVIEW_REQUIRED' END END AS status,
        CAST((o_orderkey * 37) % 129 AS DOUBLE) / 128 AS overall_confidence, o_orderkey % 4 = 0 AS review_required, o_orderdate AS created_at,
        '₹' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || '/-' AS amount_text, CAST(floor(o_totalprice) AS BIGINT) AS amount FROM orders""",
    "fields_": f"""SELECT {LINE} AS id, l_orderkey AS cheque_id,
        CASE l_linenumber WHEN 1 THEN 'amount' WHEN 2 THEN 'account_number' WHEN 3 THEN 'date' WHEN 4 THEN 'cheque_number' WHEN 5 THEN 'payee_name' ELSE 'other' END AS field_name,
        '₹' || CAST((l_partkey * 37 + l_suppkey) % 90000 AS STRING) AS normalized_value, {LINE_CONF} AS confidence,
        CAST((l_orderkey + l_partkey) % 129 AS DOUBLE) / 128 AS detection_confidence, CAST((l_suppkey * 3 + l_linenumber) % 129 AS DOUBLE) / 128 AS extraction_confidence,
        CASE l_partkey % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'recognizer' ELSE 'hybrid' END AS extraction_method, {TIER.format(c=LINE_CONF)} AS confidence_tier FROM lineitem""",
    "checks_": f"""SELECT {LINE} AS id, l_orderkey AS cheque_id, 'CHECK_' || l_returnflag AS check_type,
        CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN 'INVALID' WHEN 1 THEN 'WARNING' ELSE 'VALID' END AS validation_status, (l_orderkey + l_linenumber) % 5 > 1 AS is_valid,
        l_linestatus || CAST(l_linenumber AS STRING) AS validation_reason, CASE l_partkey % 4 WHEN 0 THEN 'PENDING' ELSE 'ACCEPTED' END AS review_resolution FROM lineitem""",
    "runs_": """SELECT event_id AS id, user_id AS cheque_id, ts AS run_timestamp, value AS total_latency_ms, event_type, props FROM events""",
    "samples_": """SELECT doc_id AS sample_id, doc_id AS ordinal, text, lang AS category, source,
        CASE doc_id % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'test' WHEN 2 THEN 'benchmark' ELSE 'train' END AS source_split, sha2(text, 256) AS image_hash FROM documents""",
    "boxes_": """SELECT l_orderkey AS image_id, CAST(l_linenumber % 4 AS INT) AS class_id, l_partkey * 10000 + l_suppkey AS pred_id,
        CAST((l_partkey * 31 + l_suppkey) % 1009 AS DOUBLE) / 1009 AS score, CAST(l_partkey % 40 AS DOUBLE) AS x, CAST(l_suppkey % 30 AS DOUBLE) AS y, CAST(20 + l_partkey % 25 AS DOUBLE) AS w, CAST(15 + l_suppkey % 20 AS DOUBLE) AS h FROM lineitem
        WHERE l_linenumber > 3""",
    "truths_": """SELECT l_orderkey AS image_id, CAST(l_linenumber % 4 AS INT) AS class_id, l_partkey * 10000 + l_suppkey AS truth_id,
        CAST(l_suppkey % 40 AS DOUBLE) AS x, CAST(l_partkey % 30 AS DOUBLE) AS y, CAST(22 + l_suppkey % 25 AS DOUBLE) AS w, CAST(16 + l_partkey % 20 AS DOUBLE) AS h FROM lineitem WHERE l_linenumber <= 3 AND l_linenumber > 0""",
    "classified_": """SELECT vec_id AS ordinal, CAST(label AS INT) AS truth, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + vec_id) % 10 ELSE label END AS INT) AS predicted,
        CAST((vec_id * 29) % 129 AS DOUBLE) / 128 AS confidence FROM embeddings""",
    "texts_": """SELECT c_custkey AS doc_id, CASE c_custkey % 3 WHEN 0 THEN 'amount' WHEN 1 THEN 'date' ELSE 'name' END AS field, c_name AS truth,
        CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN upper(c_name) WHEN 2 THEN substr(c_name, 1, 12) WHEN 3 THEN '' ELSE replace(c_name, '0', 'O') END AS predicted,
        CAST(400 + (c_custkey * 7) % 500 AS INT) AS w, CAST(200 + (c_custkey * 3) % 300 AS INT) AS h, CASE c_custkey % 4 WHEN 0 THEN 'recognizer' ELSE 'ocr' END AS method, CAST((c_custkey * 11) % 129 AS DOUBLE) / 128 AS confidence FROM customer""",
    "tokens_": """SELECT conv_id AS field_id, turn AS line_num, 1 AS word_num, text, CAST((conv_id * 7 + turn * 3) % 129 AS DOUBLE) / 128 AS conf FROM conversations""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or one in its role (names that end with _)."""
    if name in ROLES:
        text = ROLES[name]
        base = text.rpartition("FROM ")[2].split()[0]
        return spark.sql(text.replace(f"FROM {base}", "FROM {base}"), base=spark.read.parquet(f"{sf_dir}/{base}.parquet"))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(sql: str) -> str:
    """The SQL with the roles that it names written out in front."""
    used = [n for n in ROLES if n in sql]
    text = {n: ROLES[n].replace("sha2(text, 256)", "sha256(text)") for n in used}
    return ("WITH " + ", ".join(f"{n} AS ({text[n]})" for n in used) + ("," if sql.lstrip().upper().startswith("WITH ") else "") + (sql.lstrip()[4:] if sql.lstrip().upper().startswith("WITH ") else f" {sql}")) if used else sql
