"""Changes to tables as joins: each returns the new state or the rows to append; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import dealt


def upsert(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Matched rows take the changes' non-null values, unmatched changes are added. Changes have one row for each key."""
    new = changes.select(*key, *[F.col(c).alias(f"__new_{c}") for c in changes.columns if c not in key])
    merged = base.join(new, key, "full_outer")
    return merged.select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in changes.columns and c not in key else F.col(c) for c in base.columns])


def update_status(documents: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """changes (id, status, overall_confidence?, review_required?); only changed rows get a new updated_at."""
    new = changes.select("id", *[F.col(c).alias(f"__{c}") for c in changes.columns if c != "id"], F.lit(True).alias("__hit"))
    out = documents.join(new, "id", "left")
    take = lambda c: F.coalesce(f"__{c}", c).alias(c) if c in changes.columns and c != "id" else F.when(F.col("__hit"), now).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c)
    return out.select(*[take(c) for c in documents.columns])


def resolve_checks(checks: DataFrame, resolutions: DataFrame, now: Column) -> DataFrame:
    """resolutions (id, resolution, reviewer) by check."""
    new = resolutions.select("id", F.col("resolution").alias("__resolution"), F.col("reviewer").alias("__reviewer"))
    out = checks.join(new, "id", "left")
    hit = F.col("__resolution").isNotNull()
    changed = {"review_resolution": F.coalesce("__resolution", "review_resolution"), "reviewed_by_user_id": F.when(hit, F.col("__reviewer")).otherwise(F.col("reviewed_by_user_id")), "reviewed_at": F.when(hit, now).otherwise(F.col("reviewed_at"))}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in checks.columns])


def apply_corrections(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """corrections (cheque_id, field_name, value): matched fields get the value, full confidence and the method of a manual
    correction, their detection and extraction confidence stay; new ones are added with both at 1."""
    key = ["cheque_id", "field_name"]
    new = corrections.select(*key, F.col("value").alias("__value"))
    out = fields.withColumn("__old", F.lit(True)).join(new, key, "full_outer")
    hit, added = F.col("__value").isNotNull(), F.col("__old").isNull()
    changed = {
        "raw_value": F.when(hit, F.col("__value")).otherwise(F.col("raw_value")), "normalized_value": F.when(hit, F.col("__value")).otherwise(F.col("normalized_value")),
        "confidence": F.when(hit, 1.0).otherwise(F.col("confidence")), "confidence_tier": F.when(hit, "HIGH").otherwise(F.col("confidence_tier")),
        "extraction_method": F.when(hit, "manual_correction").otherwise(F.col("extraction_method")),
        "detection_confidence": F.when(added, 1.0).otherwise(F.col("detection_confidence")), "extraction_confidence": F.when(added, 1.0).otherwise(F.col("extraction_confidence")),
    }
    return out.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in fields.columns])


def promoted(checks: DataFrame, done: tuple[str, ...] = ("ACCEPTED", "CORRECTED", "REJECTED")) -> DataFrame:
    """Documents all of whose checks are resolved."""
    return checks.groupBy("cheque_id").agg(F.bool_and(F.coalesce(F.col("review_resolution").isin(*done), F.lit(False))).alias("all_resolved")).where("all_resolved").select("cheque_id")


def cascade_delete(deleted: DataFrame, *tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """Each table without the rows whose column names a deleted id."""
    return [t.join(deleted.select(F.col("id").alias(c)), c, "left_anti").select(*t.columns) for t, c in tables]


def set_null(rows: DataFrame, deleted: DataFrame, column: str) -> DataFrame:
    gone = deleted.select(F.col("id").alias(column), F.lit(True).alias("__gone"))
    out = rows.join(gone, column, "left")
    return out.select(*[F.when(F.col("__gone").isNull(), F.col(c)).alias(c) if c == column else F.col(c) for c in rows.columns])


def audit_event(rows: DataFrame, action: str, resource_type: str, resource: str, details: dict[str, Column], now: Column, username: Column | None = None) -> DataFrame:
    """Rows to append to the audit table: resource ids as text, details a map (empty if none)."""
    made = F.create_map(*[x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]) if details else F.create_map().cast("map<string,string>")
    return rows.select(now.alias("timestamp"), (username if username is not None else F.lit("system")).alias("username"), F.lit(action).alias("action"), F.lit(resource_type).alias("resource_type"), F.col(resource).cast("string").alias("resource_id"), made.alias("details"))


def status_changes(before: DataFrame, after: DataFrame, now: Column) -> DataFrame:
    """An audit row for each document whose status differs."""
    new = after.select("id", F.col("status").alias("new_status"))
    both = before.select("id", F.col("status").alias("old_status")).join(new, "id").where(~F.col("old_status").eqNullSafe(F.col("new_status")))
    return audit_event(both, "STATUS_CHANGE", "cheque", "id", {"old_status": F.col("old_status"), "new_status": F.col("new_status")}, now)


def duplicates_of_key(rows: DataFrame, key: str) -> DataFrame:
    """Keys that are there more than once; a task holds a bounded number of them, though nearly all rows have one of their own."""
    keys = rows.select(key)
    return dealt(keys, [key], keys.count()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(children: DataFrame, column: str, parents: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose reference is set and names no parent."""
    return children.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)), column, "left_anti")


def persist_result(documents: DataFrame, results: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The five tables' rows of a batch of results (doc_id, image_hash, status, overall_confidence, review_required, run_status,
    latency, fields array<struct>, reasons, priority): documents as an upsert, the others to append.

    A document's results carry the id of their run, a hash of document and image, so a batch that is written again is known
    by its ids. A document with several results counts with the last by image hash; a failed run keeps its status."""
    from .review import prediction_rows, validation_rows

    once = last_changes(results, ["doc_id"], "image_hash")
    once = once.withColumn("run_id", F.xxhash64("doc_id", "image_hash"))
    changes = once.select(F.col("doc_id").alias("id"), "status", "overall_confidence", "review_required", now.alias("updated_at"))
    fields = once.select("doc_id", "run_id", F.inline("fields"))
    runs = once.select(F.col("run_id").alias("id"), F.col("doc_id").alias("cheque_id"), now.alias("run_timestamp"), F.coalesce("run_status", F.lit("SUCCESS")).alias("status"), F.col("latency").alias("total_latency_ms"))
    owned = lambda rows: rows.join(once.select("doc_id", "run_id"), "doc_id").withColumnsRenamed({"doc_id": "cheque_id", "run_id": "processing_run_id"})
    return {
        "documents": upsert(documents, changes, ["id"]),
        "processing_runs": runs,
        "extracted_fields": fields.withColumnsRenamed({"doc_id": "cheque_id", "run_id": "processing_run_id"}).withColumn("id", F.xxhash64("processing_run_id", "field_name")),
        "predictions": owned(prediction_rows(fields.drop("run_id"))),
        "validation_results": owned(validation_rows(once)),
    }


def last_changes(changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each key: the last by ``order``, so that repeated changes do not multiply what they change."""
    rest = [c for c in changes.columns if c not in key]
    return changes.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__last")).select(*key, "__last.*")


def short_id(*parts: Column) -> Column:
    """A reproducible identifier: the first eight hexadecimal digits, upper case, of a digest."""
    return F.upper(F.substr(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), F.lit(1), F.lit(8)))


def correct_documents(documents: DataFrame, fields: DataFrame, checks: DataFrame, corrections: DataFrame, reviewer: Column, now: Column, status: str = "VERIFIED") -> dict[str, DataFrame]:
    """The correction of documents as one change: their fields take the values (the last of repeated ones), all their checks
    are resolved as corrected, and with status VERIFIED the review flag is cleared and the checks are valid."""
    once = last_changes(corrections, ["cheque_id", "field_name"], "order").drop("order")
    touched = once.select("cheque_id").distinct().withColumn("__hit", F.lit(True))
    new = checks.join(touched, "cheque_id", "left")
    hit, verified = F.coalesce("__hit", F.lit(False)), status == "VERIFIED"
    take = {"review_resolution": F.lit("CORRECTED"), "reviewed_by_user_id": reviewer, "reviewed_at": now}
    if verified:
        take |= {"is_valid": F.lit(True), "validation_status": F.lit("VALID")}
    changes = touched.select(F.col("cheque_id").alias("id"), F.lit(status).alias("status"), *([F.lit(False).alias("review_required")] if verified else []))
    return {
        "documents": update_status(documents, changes, now),
        "fields": apply_corrections(fields, once),
        "checks": new.select(*[F.when(hit, take[c]).otherwise(F.col(c)).alias(c) if c in take else F.col(c) for c in checks.columns]),
    }


def resolve_documents(documents: DataFrame, fields: DataFrame, checks: DataFrame, resolutions: DataFrame, corrections: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Resolutions of single checks with the corrections that go with them; a document whose checks are all resolved now, and
    that had a resolution, becomes VERIFIED and loses its review flag. Of repeated resolutions and corrections the last counts."""
    resolved = resolve_checks(checks, last_changes(resolutions, ["id"], "order").drop("order"), now)
    touched = checks.join(resolutions.select("id").distinct(), "id", "left_semi").select("cheque_id").distinct()
    done = promoted(resolved).join(touched, "cheque_id", "left_semi")
    changes = done.select(F.col("cheque_id").alias("id"), F.lit("VERIFIED").alias("status"), F.lit(False).alias("review_required"))
    once = last_changes(corrections, ["cheque_id", "field_name"], "order").drop("order")
    return {"documents": update_status(documents, changes, now), "fields": apply_corrections(fields, once), "checks": resolved}
