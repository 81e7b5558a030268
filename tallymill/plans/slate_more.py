"""Look-ups, records, manifests, whole changes and image sections on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, money, normalize
from ..functions.let import staged
from ..operators import datasets, evaluate, kpi, ledger, mutate, tokens
from .slate import REVIEW, VALID, pct, slate
from .slate_fields import DETECTED, UNIQUE_BOXES, _keyed, detection_metrics

# Look-ups and filters


@slate("SELECT id, status FROM documents_ WHERE cheque_identifier = 'CHQ-7' UNION ALL SELECT id, status FROM documents_ WHERE id = 32")
def point_lookup(documents_):
    found = ledger.lookup(documents_, "cheque_identifier", "CHQ-7").unionByName(ledger.lookup(documents_, "id", 32))
    return found.select("id", "status")


@slate("SELECT sample_id, category, source_split FROM samples_ WHERE source_split = 'train' AND category = 'en'")
def dataset_filter(samples_):
    return datasets.of_kind(samples_, "train", "en", "source_split", "category").select("sample_id", "category", "source_split")


@slate(f"SELECT image_id, class_id, pred_id, score FROM {UNIQUE_BOXES} WHERE score >= 0.3 AND class_id <> 0 AND class_id IN (0, 1, 2)")
def detection_filter(boxes_):
    return evaluate.above_threshold(boxes_.distinct(), 0.3, [0, 1, 2]).select("image_id", "class_id", "pred_id", "score")


@slate("""SELECT 'all' AS bounds, field_name, count(*) AS n FROM fields_ GROUP BY 2 UNION ALL SELECT 'dated', field_name, count(*) FROM fields_ JOIN documents_ d ON d.id = cheque_id
    WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '1997-12-31' GROUP BY 2""")
def bounded_fields(fields_, documents_):
    counted = lambda rows, name: rows.groupBy("field_name").agg(F.count("*").alias("n")).select(F.lit(name).alias("bounds"), "field_name", "n")
    return counted(kpi.dated(fields_, documents_), "all").unionByName(counted(kpi.dated(fields_, documents_, "1996-01-01", "1997-12-31"), "dated"))


# Records of key figures

AMOUNT = "TRY_CAST(nullif(regexp_replace(amount_text, '[^0-9.]', '', 'g'), '') AS DOUBLE)"
KPI = {
    "amounts": f"""(SELECT CAST(count(x) AS DOUBLE) AS cheques_with_amount_count, round(sum(x), 2) AS total_recognized_amount, round(avg(x), 2) AS average_amount, round(median(x), 2) AS median_amount, round(min(x), 2) AS min_amount,
        round(max(x), 2) AS max_amount, round(stddev_pop(x), 2) AS std_amount FROM (SELECT {AMOUNT} AS x FROM documents_))""",
    "reviews": f"(SELECT CAST(count(*) AS DOUBLE) AS total_cheques, CAST({REVIEW} AS DOUBLE) AS review_required_count, CAST(count(*) - {REVIEW} AS DOUBLE) AS auto_cleared_count, {pct(REVIEW)} AS manual_review_rate_pct, round(avg(overall_confidence), 4) AS average_confidence FROM documents_)",
    "validation": f"(SELECT CAST(count(*) AS DOUBLE) AS total_checks, CAST({VALID} AS DOUBLE) AS valid_count, CAST(count(*) - {VALID} AS DOUBLE) AS invalid_count, {pct(VALID)} AS pass_rate_pct FROM checks_)",
    "latency": """(SELECT CAST(count(*) AS DOUBLE) AS total_runs, round(avg(x), 2) AS avg_latency_ms, round(min(x), 2) AS min_latency_ms, round(max(x), 2) AS max_latency_ms, round(quantile_disc(x, 0.5), 2) AS p50_latency_ms,
        round(quantile_disc(x, 0.9), 2) AS p90_latency_ms, round(quantile_disc(x, 0.99), 2) AS p99_latency_ms FROM (SELECT total_latency_ms AS x FROM runs_))""",
}


@slate(" UNION ALL ".join(f"SELECT '{name}' AS record, measure, value FROM {sql} UNPIVOT (value FOR measure IN ({', '.join(kpi.RECORDS[name].values())}))" for name, sql in KPI.items()))
def kpi_records(documents_, checks_, runs_):
    return kpi.measures(
        amounts=kpi.record("amounts", kpi.amount_stats(documents_, "amount_text")), reviews=kpi.record("reviews", kpi.review_stats(documents_)),
        validation=kpi.record("validation", kpi.validation_overall(checks_)), latency=kpi.record("latency", kpi.latency_stats(runs_)),
    )


@slate("""SELECT field_name, count(*) AS total_extractions, count(*) FILTER (confidence_tier = 'HIGH') AS high_tier_count, count(*) FILTER (confidence_tier = 'MEDIUM') AS medium_tier_count, count(*) FILTER (confidence_tier = 'LOW') AS low_tier_count,
    count(*) FILTER (extraction_method = 'ocr') AS ocr_method_count, count(*) FILTER (extraction_method = 'recognizer') AS recognizer_method_count FROM fields_ GROUP BY 1""")
def field_records(fields_):
    return kpi.record("fields", kpi.field_performance(fields_)).select("field_name", *kpi.RECORDS["fields"].values())


@slate("""SELECT CAST(count(x) AS BIGINT) AS total_evaluated, round(avg(x), 4) AS mean_confidence, round(median(x), 4) AS median_confidence, round(stddev_pop(x), 4) AS std_confidence FROM (SELECT overall_confidence AS x FROM documents_)""")
def confidence_record(documents_):
    return kpi.record("confidence", kpi.confidence_histogram(documents_, "overall_confidence")).select(*kpi.RECORDS["confidence"].values())


@slate(f"SELECT confidence_tier, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM documents_)')} AS rate FROM fields_ GROUP BY 1")
def frequency_rates(fields_, documents_):
    return kpi.rates(fields_, "confidence_tier", documents_)


REASONS = "(SELECT validation_reason AS r, count(*) AS n FROM checks_ WHERE validation_status IN ('INVALID', 'WARNING') GROUP BY 1 ORDER BY n DESC, r LIMIT 10)"


@slate(f"""SELECT * FROM (SELECT count(*) AS volume_total, {pct(REVIEW)} AS review_rate, array_to_string([count(*) FILTER (overall_confidence < 0.5), count(*) FILTER (overall_confidence >= 0.5 AND overall_confidence < 0.7),
      count(*) FILTER (overall_confidence >= 0.7 AND overall_confidence < 0.85), count(*) FILTER (overall_confidence >= 0.85 AND overall_confidence < 0.95), count(*) FILTER (overall_confidence >= 0.95)], ',') AS buckets FROM documents_)
    CROSS JOIN (SELECT string_agg(status || '=' || n, ',' ORDER BY status) AS statuses FROM (SELECT status, count(*) AS n FROM documents_ GROUP BY 1))
    CROSS JOIN (SELECT string_agg(t || '=' || n, ',' ORDER BY t) AS types FROM (SELECT check_type AS t, count(*) AS n FROM checks_ GROUP BY 1))
    CROSS JOIN (SELECT string_agg(r || '=' || n, ',' ORDER BY n, r) AS reasons FROM {REASONS})
    CROSS JOIN (SELECT string_agg(f || '=' || n, ',' ORDER BY f) AS fields FROM (SELECT field_name AS f, count(*) AS n FROM fields_ GROUP BY 1))""")
def executive_record(documents_, fields_, checks_, runs_):
    made = kpi.executive_record(documents_, documents_, fields_, checks_, runs_, "amount_text")
    told = lambda c, k: F.array_join(F.transform(c, lambda x: F.concat(x[k], F.lit("="), x["n" if c not in ("checks_by_type",) else "total"].cast("string"))), ",")
    return made.select(
        "volume_total", "review_rate", F.array_join(F.col("confidence_buckets").cast("array<string>"), ",").alias("buckets"), told("statuses", "status").alias("statuses"),
        told("checks_by_type", "check_type").alias("types"), told("top_reasons", "validation_reason").alias("reasons"), told("fields", "field_name").alias("fields"),
    )


@slate("SELECT ordinal, truth, predicted FROM classified_ WHERE truth <> predicted OR confidence < 0.7 ORDER BY ordinal LIMIT 60")
def first_error_cases(classified_):
    return evaluate.first_errors(evaluate.error_cases(classified_)).select("ordinal", "truth", "predicted")


@slate(r"SELECT id, '₹' || format('{:,.2f}', CAST(amount AS DOUBLE)) AS shown, format('{:,.1f}', CAST(amount AS DOUBLE)) AS plain FROM documents_")
def money_texts(documents_):
    return documents_.select("id", money.rupees(F.col("amount")).alias("shown"), money.thousands(F.col("amount"), 1).alias("plain"))


# Manifests


@slate("SELECT sample_id, image_hash, category FROM samples_ WHERE sample_id % 3 = 0")
def manifest_samples(samples_):
    known = samples_.where("sample_id % 3 = 0").select("sample_id", "image_hash")
    lost = known.select((-1 - F.col("sample_id")).alias("sample_id"), "image_hash")
    return datasets.with_samples(known.unionByName(lost), samples_).select("sample_id", "image_hash", "category")


@slate("""SELECT dataset, count(*) AS n, count(category) AS with_category FROM (SELECT 'scans' AS dataset, category FROM samples_ WHERE source_split = 'train' UNION ALL SELECT 'made', category FROM samples_ WHERE source_split = 'val'
    UNION ALL SELECT 'handwritten', NULL FROM samples_ WHERE source_split NOT IN ('train', 'val')) GROUP BY 1""")
def united_datasets(samples_):
    part = lambda where, *more: samples_.where(where).select("sample_id", "image_hash", *more)
    made = datasets.united(scans=part("source_split = 'train'", "category"), made=part("source_split = 'val'", "category"), handwritten=part("source_split not in ('train', 'val')"))
    return made.groupBy("dataset").agg(F.count("*").alias("n"), F.count("category").alias("with_category"))


def _mapped(samples):
    zero = geometry.box(*[F.lit(0.0)] * 4)
    first, second = F.when(F.col("sample_id") % 2 == 0, F.concat(F.lit("l"), (F.col("sample_id") % 5).cast("string"))).otherwise("amount"), F.lit("date")
    return samples.select("sample_id", "category", F.create_map(first, zero, second, zero).alias("annotations"))


@slate("""SELECT category, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT category, unnest([CASE WHEN sample_id % 2 = 0 THEN 'l' || CAST(sample_id % 5 AS STRING) ELSE 'amount' END, 'date']) AS label FROM samples_) GROUP BY 1""")
def label_lists(samples_):
    return datasets.label_lists(_mapped(samples_), "category").select("category", F.array_join("labels", ",").alias("labels"))


@slate("""SELECT cheque_id, name, max_by(value, pos) AS value FROM (SELECT cheque_id, id AS pos, field_name AS name, normalized_value AS value FROM (SELECT DISTINCT * FROM fields_) UNION ALL SELECT cheque_id, id, 'method', extraction_method FROM (SELECT DISTINCT * FROM fields_)) GROUP BY 1, 2""")
def merged_maps(fields_):
    rows = fields_.distinct().select("cheque_id", "id", F.create_map(F.col("field_name"), F.col("normalized_value"), F.lit("method"), F.col("extraction_method")).alias("m"))
    return datasets.merged_maps(rows, "cheque_id", "m", "id")


@slate("""SELECT split, row_number() OVER (PARTITION BY split ORDER BY sample_id) AS image_id, sample_id, 'scan' || CAST(sample_id AS STRING) || '.tif' AS file_name FROM (
    SELECT o_orderkey AS sample_id, CASE WHEN o_orderkey % 5 = 0 THEN 'val' ELSE 'train' END AS split, o_custkey % 30 - 2 AS w, o_orderkey % 20 - 1 AS h FROM orders) WHERE w > 0 AND h > 0""")
def coco_images(orders):
    k = F.col("o_orderkey")
    samples = orders.select(k.alias("sample_id"), k.alias("ordinal"), F.when(k % 5 == 0, "val").otherwise("train").alias("split"), F.concat(F.lit("scan"), k.cast("string"), F.lit(".tif")).alias("file_name"), (F.col("o_custkey") % 30 - 2).alias("width"), (k % 20 - 1).alias("height"))
    return datasets.coco_images(samples).select("split", "image_id", "sample_id", "file_name")


BOXED = """(SELECT p_partkey, p_size % 10 AS width, p_partkey % 7 AS height, CAST(p_partkey % 5 AS DOUBLE) - 1 AS x1, CAST(p_size % 6 AS DOUBLE) AS x2, CAST(p_partkey % 3 AS DOUBLE) AS y1, CAST(p_size % 4 AS DOUBLE) + p_partkey % 4 AS y2,
    p_partkey % 9 = 0 AS blank FROM part)"""
BOX_ISSUES = """array_to_string(list_filter([CASE WHEN NOT (width > 0 AND height > 0) THEN 'invalid dimensions' END, CASE WHEN blank THEN 'empty text' END, CASE WHEN x2 <= x1 THEN 'invalid x-range: amount' END,
    CASE WHEN y2 <= y1 THEN 'invalid y-range: amount' END, CASE WHEN x1 < 0 OR y1 < 0 OR x2 > width OR y2 > height THEN 'box outside image: amount' END], lambda x: x IS NOT NULL), ';')"""


def _boxed_samples(part):
    k, size = F.col("p_partkey"), F.col("p_size")
    b = geometry.box(k % 5 - 1, k % 3, size % 6, size % 4 + k % 4)
    return part.select("p_partkey", (size % 10).alias("width"), (k % 7).alias("height"), (size % 10).alias("decoded_width"), (k % 7).alias("decoded_height"), F.when(k % 9 == 0, " ").otherwise("x").alias("text"), F.create_map(F.lit("amount"), b).alias("annotations"))


@slate(f"SELECT p_partkey, {BOX_ISSUES} AS issues FROM {BOXED}")
def box_issues(part):
    return datasets.sample_issues(_boxed_samples(part)).select("p_partkey", F.array_join("issues", ";").alias("issues"))


@slate(f"""WITH j AS (SELECT {BOX_ISSUES} AS issues FROM {BOXED}), l AS (SELECT 1 AS one FROM samples_ a JOIN samples_ b ON a.image_hash = b.image_hash AND a.source_split = 'train' AND b.source_split = 'test' LIMIT 1)
    SELECT * FROM (SELECT count(*) AS total, count(*) FILTER (issues = '') AS valid, count(*) FILTER (issues <> '') AS corrupt FROM j)
    CROSS JOIN (SELECT string_agg(k || '=' || n, ',' ORDER BY k) AS details FROM (SELECT split_part(i, ':', 1) AS k, count(*) AS n FROM (SELECT unnest(string_split(issues, ';')) AS i FROM j WHERE issues <> '') GROUP BY 1))
    CROSS JOIN (SELECT count(*) > 0 AS has_leakage FROM l)""")
def collection_audit(part, samples_):
    rank = F.when(F.col("split") == "train", 0).otherwise(1)
    leaks = datasets.leakage(samples_.where("source_split in ('train', 'test')").withColumnRenamed("source_split", "split"), rank)
    made = datasets.audit(_boxed_samples(part), leaks)
    told = F.array_join(F.transform("details", lambda x: F.concat(x["kind"], F.lit("="), x["n"].cast("string"))), ",")
    return made.select("total", "valid", "corrupt", told.alias("details"), "has_leakage")


# Normaliser facts


@slate("""SELECT c_custkey, d AS text, d LIKE '0%' AS leading_zero, CAST(length(d) AS INT) AS n_digits, CASE c_custkey % 3 WHEN 0 THEN 'label_removed,letters_to_digits,digits_kept' WHEN 1 THEN 'digits_kept' ELSE 'letters_to_digits,digits_kept' END AS steps FROM (
    SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '0' ELSE CASE c_custkey % 3 WHEN 1 THEN '' ELSE '5' END END || CAST(c_custkey + 100000000 AS STRING) AS d FROM customer)""")
def account_facts(customer):
    k = F.col("c_custkey")
    raw = F.concat(F.when(k % 3 == 0, "A/c: O").when(k % 3 == 1, "").otherwise("S"), (k + 100000000).cast("string"))
    rows = staged(customer.select("c_custkey", raw.alias("raw")), lambda: {"r": normalize.account(F.col("raw"))})
    text = F.col("r.normalized_text")
    facts = normalize.account_facts(text)
    return rows.select("c_custkey", text.alias("text"), facts["leading_zero"].alias("leading_zero"), facts["n_digits"].alias("n_digits"), F.array_join(normalize.distinct_steps(F.col("r.steps"), F.col("r.steps")), ",").alias("steps"))


@slate("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'HDFC' END AS bank, CASE WHEN s_suppkey % 2 = 0 THEN lpad(CAST(s_suppkey % 1000000 AS STRING), 6, '0') END AS branch FROM supplier""")
def branch_parts(supplier):
    k = F.col("s_suppkey")
    raw = F.concat(F.lit("hdfc0"), F.when(k % 2 == 0, F.lpad((k % 1000000).cast("string"), 6, "0")).otherwise(""))
    rows = staged(supplier.select("s_suppkey", raw.alias("raw")), lambda: {"r": normalize.branch(F.col("raw"))})
    parts = normalize.branch_parts(F.col("r.normalized_text"))
    return rows.select("s_suppkey", parts["bank"].alias("bank"), parts["branch"].alias("branch"))


@slate("SELECT n_nationkey, upper(substr(n_name, 1, 1)) || lower(substr(split_part(n_name, ' ', 1), 2)) || CASE WHEN contains(n_name, ' ') THEN ' ' || substr(split_part(n_name, ' ', 2), 1, 1) || lower(substr(split_part(n_name, ' ', 2), 2)) ELSE '' END || ' Bank' AS text, TRUE AS is_valid FROM nation")
def normalize_bank(nation):
    rows = staged(nation.select("n_nationkey", F.concat(F.lit("  "), "n_name", F.lit(" #  BANK ")).alias("raw")), lambda: {"r": normalize.bank_name(F.col("raw"))})
    return rows.select("n_nationkey", F.col("r.normalized_text").alias("text"), F.col("r.is_valid").alias("is_valid"))


@slate("SELECT field_id, CAST(position AS INT) AS position, x, sign FROM (SELECT l_orderkey AS field_id, unnest(range(len(xs))) AS position, unnest(xs) AS x, unnest(range(len(xs))) % 10 AS sign FROM (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber * 10)) AS xs FROM lineitem GROUP BY 1) WHERE l_orderkey % 2 = 0)")
def glyph_pairs(lineitem):
    boxes = lineitem.select(F.col("l_orderkey").alias("field_id"), (F.col("l_linenumber") * 10).alias("x"), F.lit(5).alias("w"))
    kept = tokens.deoverlapped(boxes)
    digits = F.array_join(F.transform(F.sequence(F.lit(0), F.size("kept") - 1), lambda i: (i % 10).cast("string")), "")
    # every second field's label is one character too long, and so is not paired
    labelled = kept.withColumn("label", F.when(F.col("field_id") % 2 == 0, digits).otherwise(F.concat(digits, F.lit("x"))))
    return tokens.paired_glyphs(labelled).select("field_id", "position", F.col("box.x").alias("x"), F.col("sign").cast("long").alias("sign"))


@slate("SELECT doc_id, field, truth, predicted FROM (SELECT a.doc_id, a.field, a.truth, CASE WHEN b.doc_id IS NULL THEN '' ELSE b.predicted END AS predicted FROM texts_ a LEFT JOIN (SELECT * FROM texts_ WHERE doc_id % 2 = 0) b ON a.doc_id = b.doc_id AND a.field = b.field) WHERE truth <> ''")
def text_pairs(texts_):
    truths, told = texts_.select("doc_id", "field", "truth"), texts_.where("doc_id % 2 = 0").select("doc_id", "field", "predicted")
    return evaluate.text_pairs(truths, told, ["doc_id", "field"]).select("doc_id", "field", "truth", "predicted")


@slate("SELECT id, upper(substr(sha256(CAST(id AS STRING) || '|' || status), 1, 8)) AS short_id FROM documents_")
def short_ids(documents_):
    return documents_.select("id", mutate.short_id(F.col("id"), F.col("status")).alias("short_id"))


# Whole changes

NOW = "TIMESTAMP '2002-01-01'"


def _checks(checks):
    rows = checks.distinct().withColumn("reviewed_by_user_id", F.lit(None).cast("int")).withColumn("reviewed_at", F.lit(None).cast("timestamp"))
    return rows.select("id", "cheque_id", "validation_status", "is_valid", "review_resolution", "reviewed_by_user_id", "reviewed_at")


def _now():
    return F.lit("2002-01-01").cast("timestamp")


@slate("""WITH t AS (SELECT id FROM documents_ WHERE id % 10 = 0), c AS (SELECT DISTINCT * FROM checks_), k AS (SELECT cheque_id, count(*) AS n, count(*) FILTER (is_valid OR cheque_id % 10 = 0) AS valid FROM c GROUP BY 1)
    SELECT d.id, CASE WHEN id % 10 = 0 THEN 'VERIFIED' ELSE status END AS status, CASE WHEN id % 10 = 0 THEN FALSE ELSE review_required END AS review_required, CASE WHEN id % 10 = 0 THEN 'E' || CAST(id AS STRING) ELSE f.v END AS date,
    coalesce(k.n, 0) AS n_checks, coalesce(k.valid, 0) AS n_valid FROM documents_ d LEFT JOIN k ON k.cheque_id = d.id LEFT JOIN (SELECT cheque_id, min_by(normalized_value, id) AS v FROM fields_ WHERE field_name = 'date' GROUP BY 1) f ON f.cheque_id = d.id""")
def correction_flow(documents_, fields_, checks_):
    ids = documents_.where("id % 10 = 0").select(F.col("id").alias("cheque_id"), F.lit("date").alias("field_name"))
    # every correction comes twice, and the later one counts
    twice = [ids.select("*", F.concat(F.lit(t), F.col("cheque_id").cast("string")).alias("value"), F.lit(i).alias("order")) for i, t in enumerate(("D", "E"))]
    docs = documents_.select("id", "status", "review_required", F.col("created_at").alias("updated_at"))
    made = mutate.correct_documents(docs, _keyed(fields_), _checks(checks_), twice[0].unionByName(twice[1]), F.lit(7), _now())
    checked = made["checks"].groupBy(F.col("cheque_id").alias("id")).agg(F.count("*").alias("n_checks"), F.count_if("is_valid").alias("n_valid"))
    dates = made["fields"].where("field_name = 'date'").select(F.col("cheque_id").alias("id"), F.col("normalized_value").alias("date"))
    return made["documents"].select("id", "status", "review_required").join(dates, "id", "left").join(checked, "id", "left").na.fill(0, ["n_checks", "n_valid"])


@slate("""WITH c AS (SELECT DISTINCT id, cheque_id, review_resolution FROM checks_), r AS (SELECT id, cheque_id, CASE WHEN id % 3 > 0 THEN 'ACCEPTED' ELSE review_resolution END AS now, id % 3 > 0 AS hit FROM c),
    done AS (SELECT cheque_id FROM r GROUP BY 1 HAVING bool_and(now = 'ACCEPTED') AND bool_or(hit)) SELECT id, CASE WHEN id IN (SELECT cheque_id FROM done) THEN 'VERIFIED' ELSE status END AS status,
    CASE WHEN id IN (SELECT cheque_id FROM done) THEN FALSE ELSE review_required END AS review_required FROM documents_""")
def resolution_flow(documents_, fields_, checks_):
    checks = _checks(checks_)
    wanted = checks.where("id % 3 > 0").select("id", F.lit("REJECTED").alias("resolution"), F.lit(7).alias("reviewer"), F.lit(0).alias("order"))
    wanted = wanted.unionByName(wanted.withColumns({"resolution": F.lit("ACCEPTED"), "order": F.lit(1)}))
    docs = documents_.select("id", "status", "review_required", F.col("created_at").alias("updated_at"))
    none = documents_.where("id < 0").select(F.col("id").alias("cheque_id"), F.lit("date").alias("field_name"), F.lit("").alias("value"), F.lit(0).alias("order"))
    return mutate.resolve_documents(docs, _keyed(fields_), checks, wanted, none, _now())["documents"].select("id", "status", "review_required")


def _results(documents, fields):
    made = fields.distinct().groupBy(F.col("cheque_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("field_name", "id", F.col("normalized_value").alias("raw_value"), F.col("extraction_method").alias("method"), "extraction_confidence"))).alias("fields"))
    k = F.col("id")
    docs = documents.where("id % 2 = 0").select(
        k.alias("doc_id"), F.sha2(k.cast("string"), 256).alias("image_hash"), F.lit("REVIEW_REQUIRED").alias("status"), F.lit(0.5).alias("overall_confidence"), F.lit(True).alias("review_required"), F.when(k % 4 == 0, "ERROR").otherwise("SUCCESS").alias("run_status"),
        F.lit(12.5).alias("latency"), F.array(F.lit("a"), F.lit("b")).alias("reasons"), F.lit("MEDIUM").alias("priority"),
    )
    return docs.join(made, "doc_id", "left").withColumn("fields", F.coalesce("fields", F.array().cast(made.schema["fields"].dataType)))


@slate("""SELECT 'documents' AS part, CASE WHEN id % 2 = 0 THEN 'REVIEW_REQUIRED' ELSE status END AS status, count(*) AS n FROM documents_ GROUP BY 2 UNION ALL SELECT 'runs', CASE WHEN id % 4 = 0 THEN 'ERROR' ELSE 'SUCCESS' END, count(*) FROM documents_ WHERE id % 2 = 0 GROUP BY 2
    UNION ALL SELECT 'fields', NULL, count(*) FROM (SELECT DISTINCT * FROM fields_) WHERE cheque_id IN (SELECT id FROM documents_ WHERE id % 2 = 0) UNION ALL SELECT 'predictions', NULL, count(*) FROM (SELECT DISTINCT * FROM fields_) WHERE cheque_id IN (SELECT id FROM documents_ WHERE id % 2 = 0)
    UNION ALL SELECT 'checks', 'WARNING', 2 * count(*) FROM documents_ WHERE id % 2 = 0""")
def persisted_results(documents_, fields_):
    docs = documents_.select("id", "status", "overall_confidence", "review_required", F.col("created_at").alias("updated_at"))
    made = mutate.persist_result(docs, _results(documents_, fields_).drop("id"), _now())
    counted = lambda name, rows, status: rows.groupBy(status.alias("status")).agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "status", "n")
    nothing = F.lit(None).cast("string")
    parts = [
        counted("documents", made["documents"], F.col("status")), counted("runs", made["processing_runs"], F.col("status")), counted("fields", made["extracted_fields"], nothing),
        counted("predictions", made["predictions"], nothing), counted("checks", made["validation_results"], F.col("validation_status")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@slate("""SELECT coalesce(a.id, b.id) AS id, coalesce(b.status, a.status) AS status FROM (SELECT id, status FROM documents_ WHERE id % 2 = 0) a FULL JOIN (SELECT id, 'E' || CAST(id % 5 AS STRING) AS status FROM documents_ WHERE id % 3 = 0) b ON a.id = b.id""")
def document_upsert(documents_):
    base = documents_.where("id % 2 = 0").select("id", "status")
    new = documents_.where("id % 3 = 0").select("id", F.concat(F.lit("E"), (F.col("id") % 5).cast("string")).alias("status"), F.lit(2).alias("order"))
    changes = mutate.last_changes(new.unionByName(new.withColumns({"status": F.lit("old"), "order": F.lit(1)})), ["id"], "order").drop("order")
    return mutate.upsert(base, changes, ["id"])


@slate("SELECT cheque_id, string_agg(field_name, ',' ORDER BY field_name, id) AS names FROM fields_ GROUP BY 1")
def fields_by_name(fields_):
    return ledger.fields_by_name(fields_).select("cheque_id", F.array_join("names", ",").alias("names"))


@slate(f"""SELECT count(*) AS classes, round(avg(precision), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall, round(avg(f1), 4) AS macro_f1 FROM ({DETECTED})""")
def macro_detection(boxes_, truths_):
    return evaluate.macro_detection(detection_metrics(boxes_, truths_))
