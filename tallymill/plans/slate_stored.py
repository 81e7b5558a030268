"""Tables that are stored and changed batch by batch, held against SQL over their last state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import geometry
from ..operators import datasets, kept, mutate
from ..operators.buckets import Buckets
from ..operators.prefix import shared_folder
from .slate import pct, slate


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@slate("""SELECT id, CASE WHEN id % 7 = 0 THEN 'VERIFIED' ELSE status END AS status, CASE WHEN id % 7 = 0 THEN NULL ELSE overall_confidence END AS overall_confidence,
    CASE WHEN id % 7 = 0 OR id % 5 <> 1 THEN review_required END AS review_required FROM documents_ WHERE id % 11 <> 0
    UNION ALL SELECT id + 100000000, 'PROCESSED', NULL, NULL FROM documents_ WHERE id % 13 = 0""")
def bucketed_merges(documents_):
    """All documents, then a batch that changes, takes away and adds some (the last change of a key counts), then that batch again."""
    spark = documents_.sparkSession
    stored = Buckets(spark, _folder(spark, "documents"), "id long, status string, overall_confidence double, review_required boolean", ["id"], 16)
    stored.merge(documents_, 1)
    change = lambda rows, key, status, at, named, gone=False: rows.select(key.alias("id"), F.lit(status).alias("status"), F.lit(None).cast("double").alias("overall_confidence"), F.lit(None).cast("boolean").alias("review_required"), F.array(*map(F.lit, named)).alias("named"), F.lit(gone).alias("deleted"), F.lit(at).alias("at"))
    k = F.col("id")
    parts = [
        change(documents_.where(k % 5 == 1), k, None, 1, ["review_required"]), change(documents_.where(k % 7 == 0), k, "VERIFIED", 2, ["status", "overall_confidence"]),
        change(documents_.where(k % 11 == 0), k, None, 3, ["status"], True), change(documents_.where(k % 13 == 0), k + 100000000, "PROCESSED", 1, ["status"]),
    ]
    changes = parts[0]
    for part in parts[1:]:
        changes = changes.unionByName(part)
    stored.merge(changes, 2, order="at")
    stored.merge(changes.withColumn("status", F.lit("again")), 2, order="at")
    return stored.rows()


def _evolved(sums: kept.Kept, rows: DataFrame, corrected: DataFrame) -> DataFrame:
    """Rows whose id is no multiple of 7 at first, then the others, then corrections of every fifth, then every 17th goes; the last
    batch is run twice. ``corrected`` has all rows as they are once corrected."""
    k, none = F.col("id"), rows.limit(0)
    sums.start(rows.where(k % 7 != 0))
    sums.apply(1, none, rows.where(k % 7 == 0))
    sums.apply(2, rows.where(k % 5 == 0), corrected.where(k % 5 == 0))
    last = rows.where((k % 17 == 0) & (k % 5 != 0)).unionByName(corrected.where((k % 17 == 0) & (k % 5 == 0)))
    sums.apply(3, last, none)
    return sums.apply(3, last, none)


WEEK = "strftime(date_trunc('week', created_at), '%Y-%m-%d') || ' (W' || lpad(CAST(CAST(floor((dayofyear(date_trunc('week', created_at)) - 1) / 7) + 1 AS INT) AS VARCHAR), 2, '0') || ')'"
NOW = """(SELECT id, created_at, CASE WHEN id % 5 = 0 THEN 'VERIFIED' ELSE status END AS status, CASE WHEN id % 5 = 0 THEN FALSE ELSE review_required END AS review_required,
    CASE WHEN id % 5 = 0 THEN 1.0 ELSE overall_confidence END AS overall_confidence FROM documents_ WHERE id % 17 <> 0)"""
FLAGGED = "count(*) FILTER (review_required)"


def _documents(documents_):
    hit = lambda value, c: F.when(F.col("id") % 5 == 0, value).otherwise(F.col(c))
    rows = documents_.select("id", "created_at", "status", "review_required", "overall_confidence")
    corrected = rows.withColumns({"status": hit("VERIFIED", "status"), "review_required": hit(False, "review_required"), "overall_confidence": hit(1.0, "overall_confidence")})
    spark = documents_.sparkSession
    return _evolved(kept.Kept(spark, _folder(spark, "kept"), kept.document_facets()), rows, corrected)


@slate(f"""SELECT {WEEK} AS period, count(*) AS total, count(*) FILTER (status = 'VERIFIED') AS verified, {FLAGGED} AS flagged, {pct(FLAGGED)} AS review_rate,
    round(avg(overall_confidence), 4) AS mean_confidence FROM {NOW} GROUP BY 1""")
def kept_volume_trend(documents_):
    return kept.volume_trend(_documents(documents_), "week")


@slate(f"SELECT status, count(*) AS n, {pct('count(*)', 'sum(count(*)) OVER ()')} AS share FROM {NOW} GROUP BY status")
def kept_status_shares(documents_):
    return kept.by_status(_documents(documents_))


@slate(f"""SELECT {WEEK} AS period, count(*) AS n, round(sum(x), 2) AS sum, round(avg(x), 2) AS mean FROM (SELECT created_at, CASE WHEN f.id % 5 = 0 THEN 100 ELSE
    TRY_CAST(nullif(regexp_replace(normalized_value, '[^0-9.]', '', 'g'), '') AS DOUBLE) END AS x FROM fields_ f JOIN documents_ d ON d.id = f.cheque_id WHERE field_name = 'amount' AND f.id % 17 <> 0) WHERE x IS NOT NULL GROUP BY 1""")
def kept_amount_trend(fields_, documents_):
    dated = documents_.select(F.col("id").alias("cheque_id"), "created_at")
    rows = fields_.where("field_name = 'amount'").join(dated, "cheque_id").select("id", "created_at", "normalized_value")
    spark = fields_.sparkSession
    sums = kept.Kept(spark, _folder(spark, "kept"), kept.amount_facets())
    return kept.amount_trend(_evolved(sums, rows, rows.withColumn("normalized_value", F.lit("₹100"))), "week")


@slate(f"""SELECT check_type, count(*) AS total, count(*) FILTER (v) AS valid, count(*) FILTER (NOT v) AS invalid, {pct('count(*) FILTER (v)')} AS pass_rate
    FROM (SELECT check_type, is_valid OR id % 5 = 0 AS v FROM checks_ WHERE id % 17 <> 0) GROUP BY 1""")
def kept_pass_rates(checks_):
    rows = checks_.select("id", "check_type", "is_valid")
    spark = checks_.sparkSession
    sums = kept.Kept(spark, _folder(spark, "kept"), kept.check_facets())
    return kept.validation_by_type(_evolved(sums, rows, rows.withColumn("is_valid", F.lit(True))))


IN_SPLITS = """(SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'val' WHEN 1 THEN 'test' WHEN 2 THEN 'unsplit' ELSE 'train' END AS split, o_custkey % 30 - 2 AS w, o_orderkey % 20 - 1 AS h FROM orders)"""


@slate(f"""WITH i AS (SELECT *, row_number() OVER (ORDER BY k) AS image_id FROM {IN_SPLITS} WHERE split <> 'unsplit')
    SELECT 'images' AS section, split, image_id AS id, CAST(NULL AS BIGINT) AS image_id, CAST(NULL AS INTEGER) AS category_id, CAST(k AS VARCHAR) AS told FROM i
    UNION ALL SELECT 'annotations', split, row_number() OVER (ORDER BY image_id, c), image_id, c, w || 'x' || h FROM i CROSS JOIN (VALUES (1), (2)) t(c) WHERE w > 0 AND h > 0
    UNION ALL SELECT 'categories', NULL, c, NULL, NULL, n FROM (VALUES (1, 'amount'), (2, 'date')) t(c, n)""")
def coco_sections(orders):
    k = F.col("o_orderkey")
    x, y, w, h = (F.expr(e).cast("double") for e in ("o_orderkey % 50", "o_custkey % 40", "o_custkey % 30 - 2", "o_orderkey % 20 - 1"))
    b = geometry.box(x, y, x + w, y + h)
    split = F.when(k % 6 == 0, "val").when(k % 6 == 1, "test").when(k % 6 == 2, "unsplit").otherwise("train")
    samples = orders.select(k.alias("sample_id"), k.alias("ordinal"), split.alias("split"), F.create_map(F.lit("amount"), b, F.lit("date"), b, F.lit("stamp"), b).alias("annotations"))
    made = datasets.coco_sections(samples, ["amount", "date"])
    none = lambda kind: F.lit(None).cast(kind)
    whole = lambda i: F.col("bbox")[i].cast("int").cast("string")
    images = made["images"].select(F.lit("images").alias("section"), "split", F.col("image_id").alias("id"), none("long").alias("image_id"), none("int").alias("category_id"), F.col("sample_id").cast("string").alias("told"))
    boxes = made["annotations"].select(F.lit("annotations"), "split", "annotation_id", "image_id", F.col("category_id").cast("int"), F.concat(whole(2), F.lit("x"), whole(3)))
    return images.union(boxes).union(made["categories"].select(F.lit("categories"), none("string"), F.col("category_id").cast("long"), none("long"), none("int"), "name"))


@slate("""SELECT 'documents' AS of_table, id, array_to_string(list_filter([CASE WHEN id % 9 = 0 THEN 'cheque_identifier_length' END, CASE WHEN id % 8 = 0 THEN 'status_word' END, CASE WHEN id % 7 = 0 THEN 'overall_confidence_range' END,
        CASE WHEN id % 5 = 0 THEN 'review_required_null' END], lambda x: x IS NOT NULL), ',') AS violations FROM documents_
    UNION ALL SELECT 'extracted_fields', id, array_to_string(list_filter([CASE WHEN id % 6 = 0 THEN 'extraction_method_word' END, CASE WHEN id % 11 = 0 THEN 'confidence_tier_length' END,
        CASE WHEN id % 11 = 0 THEN 'confidence_tier_word' END], lambda x: x IS NOT NULL), ',') FROM fields_
    UNION ALL SELECT 'validation_results', id, CASE WHEN id % 4 = 0 THEN 'check_type_length' ELSE '' END FROM checks_""")
def table_violations(documents_, fields_, checks_):
    """The rules of three tables, on rows that break some."""
    k = F.col("id")
    documents = documents_.select("id", F.when(k % 9 == 0, F.repeat(F.lit("x"), F.lit(129))).otherwise(F.col("cheque_identifier")).alias("cheque_identifier"), F.when(k % 8 == 0, "NEW").otherwise(F.col("status")).alias("status"), F.when(k % 7 == 0, F.lit(1.5)).otherwise(F.col("overall_confidence")).alias("overall_confidence"), F.when(k % 5 != 0, F.col("review_required")).alias("review_required"))
    fields = fields_.withColumn("extraction_method", F.when(k % 6 == 0, "guess").otherwise(F.col("extraction_method"))).withColumn("confidence_tier", F.when(k % 11 == 0, F.repeat(F.lit("T"), F.lit(17))).otherwise(F.col("confidence_tier")))
    checks = checks_.withColumn("check_type", F.when(k % 4 == 0, F.lit("")).otherwise(F.col("check_type")))
    parts = []
    for name, rows in (("documents", documents), ("extracted_fields", fields), ("validation_results", checks)):
        judged = datasets.violations(rows, schemas.rules(name, rows.columns))
        parts.append(judged.select(F.lit(name).alias("of_table"), "id", F.array_join("violations", ",").alias("violations")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@slate("""WITH c AS (SELECT DISTINCT id, cheque_id FROM checks_), done AS (SELECT DISTINCT cheque_id FROM c WHERE id % 3 > 0),
    f AS (SELECT DISTINCT ON (id) id, cheque_id, field_name, normalized_value, confidence, extraction_method FROM fields_ ORDER BY id),
    told AS (SELECT cheque_id, 'date' AS field_name, 'D' || cheque_id AS value FROM done)
    SELECT 'field' AS what, f.cheque_id, f.field_name AS name, CASE WHEN t.value IS NULL THEN normalized_value ELSE t.value END AS value, CASE WHEN t.value IS NULL THEN extraction_method ELSE 'manual_correction' END AS method
        FROM (SELECT cheque_id, field_name, max_by(normalized_value, id) AS normalized_value, max_by(extraction_method, id) AS extraction_method FROM f GROUP BY ALL) f LEFT JOIN told t USING (cheque_id, field_name)
    UNION ALL SELECT 'field', cheque_id, 'date', value, 'manual_correction' FROM told t WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.cheque_id = t.cheque_id AND f.field_name = 'date')
    UNION ALL SELECT 'check', cheque_id, CAST(id AS VARCHAR), CASE WHEN id % 3 > 0 THEN 'CORRECTED' ELSE 'PENDING' END, CASE WHEN id % 3 > 0 THEN '7' END FROM c""")
def resolutions_with_corrections(fields_, checks_, documents_):
    """Resolutions of checks with the corrections that go with them: fields and checks as they are then."""
    last = fields_.groupBy("cheque_id", "field_name").agg(F.max_by(F.struct(*[c for c in fields_.columns if c not in ("cheque_id", "field_name")]), "id").alias("f")).select("cheque_id", "field_name", "f.*")
    fields = last.withColumn("raw_value", F.col("normalized_value"))
    empty = {"review_resolution": F.lit("PENDING"), "reviewed_by_user_id": F.lit(None).cast("int"), "reviewed_at": F.lit(None).cast("timestamp")}
    checks = checks_.dropDuplicates(["id"]).withColumns(empty)
    hit = checks.where("id % 3 > 0")
    wanted = hit.select("id", F.lit("REJECTED").alias("resolution"), F.lit(1).alias("reviewer"), F.lit(0).alias("order"))
    wanted = wanted.unionByName(wanted.withColumns({"resolution": F.lit("CORRECTED"), "reviewer": F.lit(7), "order": F.lit(1)}))
    value = F.concat(F.lit("D"), F.col("cheque_id").cast("string"))
    told = hit.select("cheque_id").distinct().select("cheque_id", F.lit("date").alias("field_name"), value.alias("value"), F.lit(2).alias("order"))
    told = told.unionByName(told.withColumns({"value": F.lit("earlier"), "order": F.lit(1)}))
    documents = documents_.select("id", "status", "review_required", F.col("created_at").alias("updated_at"))
    made = mutate.resolve_documents(documents, fields, checks, wanted, told, F.lit("2026-01-01 00:00:00").cast("timestamp"))
    out = made["fields"].select(F.lit("field").alias("what"), "cheque_id", F.col("field_name").alias("name"), F.col("normalized_value").alias("value"), F.col("extraction_method").alias("method"))
    return out.union(made["checks"].select(F.lit("check"), "cheque_id", F.col("id").cast("string"), "review_resolution", F.col("reviewed_by_user_id").cast("string")))


@slate("SELECT image_hash, sample_id FROM samples_ QUALIFY count(*) OVER (PARTITION BY image_hash) > 1")
def duplicate_members(samples_):
    """The members of every group of duplicates as rows, whatever a group's size."""
    return datasets.duplicate_members(samples_)
