"""Schemas of the document-clearing tables, their defaults and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"

#: Column names and defaults of the tables.
TABLES = {
    "users": "id long, username string, email string, hashed_password string, role string, is_active boolean, created_at timestamp, updated_at timestamp",
    "documents": "id long, cheque_identifier string, image_path string, image_width int, image_height int, image_hash string, source_dataset string, status string, overall_confidence double, review_required boolean, created_by_user_id long, created_at timestamp, updated_at timestamp",
    "processing_runs": "id long, cheque_id long, run_timestamp timestamp, status string, detector_version string, recognizer_version string, ocr_version string, total_latency_ms double, stage_latencies map<string,double>",
    "predictions": f"id long, processing_run_id long, cheque_id long, stage string, model_name string, model_version string, field_name string, raw_output string, raw_confidence double, bounding_box {BOX}, created_at timestamp",
    "extracted_fields": f"id long, cheque_id long, processing_run_id long, field_name string, raw_value string, normalized_value string, confidence double, detection_confidence double, extraction_confidence double, extraction_method string, confidence_tier string, bounding_box {BOX}, created_at timestamp",
    "validation_results": "id long, cheque_id long, processing_run_id long, field_name string, check_type string, validation_status string, is_valid boolean, validation_reason string, review_priority string, reviewed_by_user_id long, review_resolution string, reviewed_at timestamp, created_at timestamp",
    "audit_logs": "id long, timestamp timestamp, user_id long, username string, action string, resource_type string, resource_id string, details map<string,string>, ip_address string",
}
DEFAULTS: dict[str, dict[str, object]] = {
    "users": {"role": "TELLER", "is_active": True},
    "documents": {"source_dataset": "production", "status": "PROCESSED", "overall_confidence": 0.0, "review_required": False},
    "processing_runs": {"status": "SUCCESS"},
    "extracted_fields": {"extraction_method": "ocr", "confidence_tier": "MEDIUM"},
    "validation_results": {"validation_status": "VALID", "is_valid": True, "review_priority": "MEDIUM", "review_resolution": "PENDING"},
}
STATUSES = ("PROCESSED", "VERIFIED", "REVIEW_REQUIRED", "INVALID")
TIERS = ("HIGH", "MEDIUM", "LOW")
METHODS = ("ocr", "recognizer", "hybrid", "none", "manual_correction")
RESOLUTIONS = ("PENDING", "ACCEPTED", "REJECTED", "CORRECTED")
PRIORITIES = ("HIGH", "MEDIUM", "LOW")
OUTCOMES = ("VALID", "WARNING", "INVALID")
CORE_FIELDS = ("acno", "ifsc", "date", "amount", "name")


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order, missing ones null, defaults where null; other columns are dropped."""
    defaults = DEFAULTS.get(table, {})

    def column(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        return (F.coalesce(c, F.lit(defaults[f.name])) if f.name in defaults else c).alias(f.name)

    return df.select(*[column(f) for f in schema(table)])


#: Columns that may be null, least and most characters of texts, and vocabularies.
OPTIONAL = {
    "documents": ("created_by_user_id",), "extracted_fields": ("bounding_box",), "predictions": ("bounding_box",),
    "validation_results": ("field_name", "reviewed_by_user_id", "review_resolution", "reviewed_at"), "audit_logs": ("user_id", "details", "ip_address", "resource_id"),
    "processing_runs": ("stage_latencies",),
}
LENGTHS: dict[str, dict[str, tuple[int, int]]] = {
    "users": {"username": (3, 50), "email": (5, 120), "hashed_password": (1, 255), "role": (1, 32)},
    "documents": {"cheque_identifier": (1, 128), "image_path": (1, 512), "image_hash": (64, 64), "source_dataset": (1, 64), "status": (1, 32)},
    "processing_runs": {"status": (1, 32), "detector_version": (1, 128), "recognizer_version": (1, 128), "ocr_version": (1, 128)},
    "predictions": {"stage": (1, 64), "model_name": (1, 128), "model_version": (1, 64), "field_name": (1, 64)},
    "extracted_fields": {"field_name": (1, 64), "extraction_method": (1, 32), "confidence_tier": (1, 16)},
    "validation_results": {"field_name": (1, 64), "check_type": (1, 64), "validation_status": (1, 32), "review_priority": (1, 16), "review_resolution": (1, 32)},
    "audit_logs": {"username": (1, 64), "action": (1, 64), "resource_type": (1, 64)},
}
VOCABULARIES: dict[str, dict[str, tuple[str, ...]]] = {
    "users": {"role": ("TELLER", "AUDITOR", "ADMIN", "EMPLOYEE", "ANALYST", "REVIEWER")},
    "documents": {"status": STATUSES},
    "processing_runs": {"status": ("SUCCESS", "PARTIAL", "ERROR")},
    "extracted_fields": {"extraction_method": METHODS, "confidence_tier": TIERS},
    "validation_results": {"validation_status": OUTCOMES, "review_priority": PRIORITIES, "review_resolution": RESOLUTIONS},
}
LEAST = {"documents": {"image_width": 1, "image_height": 1}, "processing_runs": {"total_latency_ms": 0}}


def rules(table: str, columns: list[str] | None = None) -> dict[str, Column]:
    """What must hold of a row of the table, by name: texts' lengths, vocabularies, confidences within 0 and 1, least numbers, and
    no null but where one may be. A column that may be null has to hold its other rules only if it is not; ``columns`` leaves out
    the rules of columns that a table lacks."""
    may = OPTIONAL.get(table, ())
    made: dict[str, Column] = {}
    for f in schema(table):
        c = f.name
        if columns is not None and c not in columns:
            continue
        told: dict[str, Column] = {}
        if c in LENGTHS.get(table, {}):
            least, most = LENGTHS[table][c]
            told[f"{c}_length"] = F.length(c).between(least, most)
        if c in VOCABULARIES.get(table, {}):
            told[f"{c}_word"] = F.col(c).isin(*VOCABULARIES[table][c])
        if c.endswith("confidence"):
            told[f"{c}_range"] = F.col(c).between(0, 1)
        if c in LEAST.get(table, {}):
            told[f"{c}_least"] = F.col(c) >= LEAST[table][c]
        if c not in may:
            made[f"{c}_null"] = F.col(c).isNotNull()
        # a null is told once, as a null
        made |= {name: F.col(c).isNull() | ok for name, ok in told.items()}
    return made
