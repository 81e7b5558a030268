"""Candidate fusion, document confidence, triage of whole tables, and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import validate as V
from ..functions.let import let, staged
from ..schemas import CORE_FIELDS


def fuse(detections: DataFrame, ocr: DataFrame, recognized: DataFrame) -> DataFrame:
    """The chosen candidate of each detected field.

    detections (doc_id, field_name, detection_confidence); ocr (…, text, raw_text, confidence, tier, valid); recognized (…,
    text, confidence, success). Amount and date may have both: a valid, good OCR wins, then a recogniser that is surer or
    alone, else both are merged."""
    key = ["doc_id", "field_name"]
    o = ocr.select(*key, F.col("text").alias("o_text"), F.col("raw_text").alias("o_raw"), F.col("confidence").alias("o_conf"), F.col("tier").alias("o_tier"), F.col("valid").alias("o_valid"), F.lit(True).alias("o"))
    r = recognized.where("success").select(*key, F.col("text").alias("r_text"), F.col("confidence").alias("r_conf"), F.lit(True).alias("r"))
    rows = detections.join(o, key, "full_outer").join(r, key, "full_outer")
    c = F.col
    has_o, has_r = c("o").isNotNull(), c("r").isNotNull()
    said = lambda x: F.coalesce(c(x), F.lit("")) != ""
    both = has_o & has_r & c("field_name").isin("amount", "date")
    surer = said("r_text") & (~said("o_text") | (c("r_conf") > c("o_conf")))
    method = F.when(both & c("o_valid") & (c("o_conf") >= 0.65), "ocr").when(both & surer, "recognizer").when(both, "hybrid").when(has_o, "ocr").when(has_r, "recognizer").otherwise("none")
    rows = rows.withColumn("method", method)
    from_r = c("method") == "recognizer"
    value = F.when(from_r, c("r_text")).when(c("method") == "hybrid", F.when(said("o_text"), c("o_text")).otherwise(c("r_text"))).otherwise(F.coalesce("o_text", F.lit("")))
    raw = F.when(from_r, c("r_text")).when(c("method") == "hybrid", F.when(said("o_raw"), c("o_raw")).otherwise(c("r_text"))).otherwise(F.coalesce("o_raw", F.lit("")))
    extraction = F.when(from_r, c("r_conf")).when(c("method") == "hybrid", F.greatest("o_conf", "r_conf")).otherwise(F.coalesce("o_conf", F.lit(0.0)))
    alone = F.when(c("r_conf") >= 0.50, "MEDIUM").otherwise("LOW")
    tier = F.when(from_r, F.when(both, V.tier(c("r_conf"))).otherwise(alone)).otherwise(F.coalesce("o_tier", F.lit("LOW")))
    rows = rows.withColumns({"value": value, "raw_value": raw, "extraction_confidence": F.round(extraction, 4), "confidence_tier": tier, "detection_confidence": F.coalesce("detection_confidence", F.lit(0.0))})
    confidence = F.when(c("value") != "", V.propagated(c("detection_confidence"), c("extraction_confidence"))).otherwise(0.0)
    return rows.select(*key, "value", "raw_value", confidence.alias("confidence"), F.round("detection_confidence", 4).alias("detection_confidence"), "extraction_confidence", "method", "confidence_tier")


def fill_missing(fields: DataFrame, documents: DataFrame, core: tuple[str, ...] = CORE_FIELDS) -> DataFrame:
    """Adds an empty row for each core field that a document lacks."""
    wanted = documents.select("doc_id", F.explode(F.array(*map(F.lit, core))).alias("field_name"))
    return fields.unionByName(wanted.join(fields, ["doc_id", "field_name"], "left_anti"), allowMissingColumns=True)


def assemble(fields: DataFrame, core: tuple[str, ...] = CORE_FIELDS) -> DataFrame:
    """Confidence of a document, its missing core fields, run status and review flag: mean over fields with a value, less 0.15
    for each core field without."""
    there = F.col("value") != ""
    found = F.collect_set(F.when(there & F.col("field_name").isin(*core), F.col("field_name")))
    made = fields.groupBy("doc_id").agg(F.avg(F.when(there, F.col("confidence"))).alias("mean"), F.count_if(F.col("confidence_tier") == "LOW").alias("low_fields"), F.array_sort(F.array_except(F.array(*map(F.lit, core)), found)).alias("missing"))
    lost = F.size("missing")
    made = made.withColumn("overall", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mean") - 0.15 * lost)), F.lit(0.0)))
    status = F.when((F.col("overall") >= 0.70) & (lost == 0), "SUCCESS").when(F.col("overall") >= 0.30, "PARTIAL").otherwise("ERROR")
    review = (F.col("low_fields") > 0) | (lost > 0) | (F.col("overall") < V.TIER_HIGH)
    return made.select("doc_id", F.round("overall", 4).alias("overall_confidence"), lost.alias("n_missing"), F.array_join("missing", ",").alias("missing"), status.alias("status"), review.alias("review_required"))


def document_confidence(fields: DataFrame, core: tuple[str, ...] = CORE_FIELDS) -> DataFrame:
    """Plain mean of all fields, with the reasons that call for a review and the tiers by field."""
    c = F.coalesce("confidence", F.lit(0.0))
    low = F.when((V.tier(c) == "LOW") & F.col("field_name").isin(*core), F.struct("field_name", F.format_string("Low confidence on mandatory field '%s': %.2f (Tier: LOW)", "field_name", c).alias("text")))
    made = fields.groupBy("doc_id").agg(F.avg(c).alias("overall"), F.array_sort(F.collect_list(low)).alias("low"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("field_name", V.tier(c))))).alias("tiers"))
    whole = F.when(F.col("overall") < V.TIER_MEDIUM, F.format_string(f"Overall document confidence %.2f is below acceptance threshold {V.TIER_MEDIUM:.2f}", "overall"))
    made = made.withColumn("reasons", F.array_compact(F.concat(F.col("low.text"), F.array(whole))))
    return made.select("doc_id", F.round("overall", 4).alias("overall_confidence"), "tiers", "reasons", (F.size("reasons") > 0).alias("review_required"))


def validate_fields(documents: DataFrame, core: tuple[str, ...] = CORE_FIELDS, reference: Column | None = None) -> DataFrame:
    """Outcomes of the core fields of wide rows: for each field a column <field>_outcome, struct(value, errors, warnings).

    documents has a column of the field's name and <field>_confidence."""
    return staged(documents, lambda: _outcomes(core, reference))


def _outcomes(core: tuple[str, ...], reference: Column | None) -> dict[str, Column]:
    day = reference if reference is not None else F.lit(None).cast("date")
    rules = {"acno": V.account, "ifsc": V.branch, "amount": V.amount, "name": V.payee, "date": lambda x: V.date(x, day)}
    return {f"{f}_outcome": rules[f](F.col(f)) for f in core}


#: What a rule says at most.
MOST_TEXTS = 5


def _tagged(texts: Column, tag: str) -> Column:
    return F.concat(*[V.when(F.size(texts) > k, F.concat(F.lit(tag), F.get(texts, F.lit(k)))) for k in range(MOST_TEXTS)])


def discrepancies(figures: Column, words: Column, code: Column, bank: Column, present: Column, confidence: Column) -> Column:
    """Array of struct(check, text, critical): what two fields, or the signature, say against each other."""
    sign = F.coalesce(confidence, F.lit(0.0))
    unsigned = V.signature_missing(present, confidence)
    entry = lambda name, text, critical: F.struct(F.lit(name).alias("check"), text.alias("text"), F.lit(critical).alias("critical"))
    nothing = F.array().cast("array<struct<check:string,text:string,critical:boolean>>")
    one = lambda holds, e: F.when(holds, F.array(e)).otherwise(nothing)
    signature = F.format_string("Signature mark not detected with sufficient confidence (%.2f < 0.50)", sign)
    return let(V.amount_mismatch(figures, words), lambda amount: let(V.bank_mismatch(code, bank), lambda name: F.concat(
        one(amount.isNotNull(), entry("amount", amount, True)), one(name.isNotNull(), entry("bank", name, False)), one(unsigned, entry("signature", signature, True)),
    )))


def triage(documents: DataFrame, reference: Column | None = None, words: str = "amt_in_words", bank: str = "bank_name") -> DataFrame:
    """Status, priority and ordered reasons of every document of a wide table (doc_id, core fields and their confidences,
    amount in words, bank name, signature_present, signature_confidence, overall_confidence): no shuffle at all.

    Reasons come field by field (errors, warnings, low confidence), then missing fields, the signature, and discrepancies
    between fields; errors, missing fields and critical discrepancies make a document invalid."""
    made = staged(documents, lambda: {"__verdict": F.struct(*[x.alias(c) for c, x in _verdict(reference, words, bank).items()])})
    # inline makes the verdict columns of their own, so filters on them above do not work the rules out again
    made = made.select("doc_id", "overall_confidence", F.inline(F.array("__verdict")))
    return made.select("doc_id", "status", "priority", "review_required", "overall_confidence", "n_fatal", "n_reasons", "reasons")


def named(x: Column) -> Column:
    return x


def _verdict(reference: Column | None, words: str, bank: str) -> dict[str, Column]:
    outcome = {f: let(x, named) for f, x in zip(CORE_FIELDS, _outcomes(CORE_FIELDS, reference).values())}
    reasons, fatal = [], []
    for f in CORE_FIELDS:
        low = let(V.low_confidence_reason(F.col(f"{f}_confidence")), named)
        own = F.concat(outcome[f]["errors"], outcome[f]["warnings"], V.when(low.isNotNull(), low))
        reasons.append(let(own, lambda texts, f=f: _tagged(texts, f"[{f.upper()}] ")))
        fatal.append(F.size(outcome[f]["errors"]))
    empty = lambda f: F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == ""
    missing = let(F.concat(*[V.when(empty(f), f"Mandatory field '{f}' has empty value") for f in ("acno", "amount", "date", "name", "ifsc")]), named)
    unsigned, sign = V.signature_missing(F.col("signature_present"), F.col("signature_confidence")), F.coalesce("signature_confidence", F.lit(0.0))
    plain = V.when(unsigned, F.format_string("Signature unconfirmed in designated signatory area (confidence: %.2f)", sign))
    figures, code = outcome["amount"]["value"], outcome["ifsc"]["value"]
    amount = let(V.amount_mismatch(figures, F.col(words)), named)
    name = let(V.bank_mismatch(code, F.col(bank)), named)
    signature = F.format_string("[CONSISTENCY] Signature mark not detected with sufficient confidence (%.2f < 0.50)", sign)
    apart = [V.when(amount.isNotNull(), F.concat(F.lit("[CONSISTENCY] "), amount)), V.when(name.isNotNull(), F.concat(F.lit("[CONSISTENCY] "), name)), V.when(unsigned, signature)]
    n_fatal = sum(fatal, F.size(missing)) + amount.isNotNull().cast("int") + F.coalesce(unsigned.cast("int"), F.lit(0))
    said = let(F.concat(*reasons, missing, plain, *apart), named)
    n_fatal = let(n_fatal, named)
    n = F.size(said)
    urgent = (F.coalesce(figures.try_cast("double"), F.lit(0.0)) >= V.TRIAGE_HIGH_VALUE) | (n >= 3)
    status = F.when(n_fatal > 0, "INVALID").when(n > 0, "REVIEW_REQUIRED").when(F.col("overall_confidence") >= V.TIER_HIGH, "VERIFIED").otherwise("PROCESSED")
    priority = F.when(n_fatal > 0, "HIGH").when(n > 0, F.when(urgent, "HIGH").otherwise("MEDIUM")).otherwise("LOW")
    return {"status": status, "priority": priority, "review_required": (n_fatal > 0) | (n > 0), "n_fatal": n_fatal, "n_reasons": n, "reasons": said}


def validation_rows(triaged: DataFrame) -> DataFrame:
    """A row for each reason; one for a document that passed every gate; none for one that is merely processed."""
    passed = F.when(F.col("status") == "VERIFIED", F.array(F.lit("All field formats, confidence gates, and consistency checks passed successfully")))
    clean = F.size("reasons") == 0
    rows = triaged.select("doc_id", "status", "priority", clean.alias("clean"), F.explode(F.when(clean, passed).otherwise(F.col("reasons"))).alias("validation_reason"))
    return rows.select(
        "doc_id", F.when(F.col("clean"), "ALL_GATES").otherwise("COMPLIANCE_GATE").alias("check_type"),
        F.when(F.col("clean"), "VALID").when(F.col("status") == "REVIEW_REQUIRED", "WARNING").otherwise("INVALID").alias("validation_status"), F.col("clean").alias("is_valid"), "validation_reason",
        F.when(F.col("clean"), "LOW").otherwise(F.col("priority")).alias("review_priority"), F.when(F.col("clean"), "ACCEPTED").otherwise("PENDING").alias("review_resolution"),
    )


def queue(items: DataFrame, ordinal: str = "doc_id", status: str | None = None, priority: str | None = None) -> DataFrame:
    """By priority, then in the order of arrival."""
    if status is not None:
        items = items.where(F.col("status") == status)
    if priority is not None:
        items = items.where(F.col("priority") == priority)
    rank = F.when(F.col("priority") == "HIGH", 0).when(F.col("priority") == "MEDIUM", 1).when(F.col("priority") == "LOW", 2).otherwise(99)
    return items.withColumn("rank", rank).orderBy("rank", ordinal)


def decisions(reviewed: DataFrame, rejected: Column | None = None) -> DataFrame:
    """ACCEPTED if no value of a document was changed, CORRECTED if one was, REJECTED where told: rows (doc_id, old, new)."""
    changed = F.bool_or(~F.col("old").eqNullSafe(F.col("new")))
    out = F.when(changed, "CORRECTED").otherwise("ACCEPTED")
    return reviewed.groupBy("doc_id").agg((out if rejected is None else F.when(F.bool_or(rejected), "REJECTED").otherwise(out)).alias("resolution"))


def prediction_rows(fields: DataFrame, ocr_version: str = "ocr-1", recognizer_version: str = "recognizer-1") -> DataFrame:
    by_ocr = F.col("method") == "ocr"
    return fields.select("doc_id", "field_name", F.concat(F.upper("method"), F.lit("_EXTRACTION")).alias("stage"), F.when(by_ocr, ocr_version).otherwise(recognizer_version).alias("model_name"), F.col("raw_value").alias("raw_output"), F.col("extraction_confidence").alias("raw_confidence"))
