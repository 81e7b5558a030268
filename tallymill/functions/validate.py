"""Validation rules as column expressions: each returns struct(value, errors, warnings), errors and warnings in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import day_month_year, first_of_month
from .let import let
from .money import amount_of, words_to_number

#: Limits, and the banks of known prefixes with the names that they go by.
VALID_DAYS, HIGH_VALUE, TRIAGE_HIGH_VALUE, SIGNATURE = 90, 500_000.0, 50_000.0, 0.50
TIER_HIGH, TIER_MEDIUM, LOW_CONFIDENCE = 0.80, 0.60, 0.70
BANKS = {
    "SBIN": ("State Bank of India", ("STATE BANK", "SBI")),
    "HDFC": ("HDFC Bank", ("HDFC",)),
    "ICIC": ("ICICI Bank", ("ICICI",)),
    "CNRB": ("Canara Bank", ("CANARA",)),
    "SYNB": ("Syndicate Bank", ("SYNDICATE", "CANARA")),
    "PUNB": ("Punjab National Bank", ("PUNJAB NATIONAL", "PNB")),
    "BARB": ("Bank of Baroda", ("BANK OF BARODA", "BOB")),
    "UTIB": ("Axis Bank", ("AXIS",)),
    "KKBK": ("Kotak Mahindra Bank", ("KOTAK",)),
    "UBIN": ("Union Bank of India", ("UNION BANK",)),
    "IDIB": ("Indian Bank", ("INDIAN BANK",)),
    "MAHB": ("Bank of Maharashtra", ("MAHARASHTRA",)),
}


def none() -> Column:
    return F.array().cast("array<string>")


def when(holds: Column, text: str | Column) -> Column:
    """One text, or none: arrays of conditions are put together without lambdas, so that rules stay in generated code."""
    return F.when(holds, F.array(F.lit(text) if isinstance(text, str) else text)).otherwise(none())


def _texts(*items: Column) -> Column:
    return F.concat(none(), *items)


def _outcome(value: Column, errors: Column, warnings: Column | None = None) -> Column:
    return F.struct(value.alias("value"), errors.alias("errors"), (none() if warnings is None else warnings).alias("warnings"))


def _value(x: Column) -> Column:
    return F.trim(F.coalesce(x.cast("string"), F.lit("")))


def said(pattern: str, *args: Column) -> Column:
    return F.format_string(pattern, *args)


def account(x: Column) -> Column:
    return let(_value(x), _account)


def _account(v: Column) -> Column:
    n, digits = F.length(v), F.rlike(v, F.lit("^[0-9]+$"))
    return _outcome(v, _texts(
        when(v == "", "Account number is empty"),
        when((v != "") & ~digits, said("Account number contains non-numeric characters: '%s'", v)),
        when(digits & (n < 9), said("Account number length (%d) is below minimum standard of 9 digits", n)),
        when(digits & (n > 18), said("Account number length (%d) exceeds maximum standard of 18 digits", n)),
    ))


def branch(x: Column) -> Column:
    return let(F.upper(_value(x)), _branch)


def _branch(v: Column) -> Column:
    n, bank, fifth, rest = F.length(v), F.substr(v, F.lit(1), F.lit(4)), F.substr(v, F.lit(5), F.lit(1)), F.substr(v, F.lit(6))
    return _outcome(v, _texts(
        when(v == "", "IFSC code is empty"),
        when((v != "") & (n != 11), said("IFSC code length (%d) is not exactly 11 characters", n)),
        when((v != "") & ~F.rlike(bank, F.lit(r"^\p{L}+$")), said("IFSC bank prefix '%s' must consist of 4 alphabetic letters", bank)),
        when((n >= 5) & (fifth != "0"), said("IFSC 5th character '%s' must be digit zero ('0')", fifth)),
        when((n == 11) & ~F.rlike(rest, F.lit(r"^[\p{L}\p{N}]+$")), said("IFSC branch suffix '%s' must be alphanumeric", rest)),
    ))


def bank_of(code: Column) -> Column:
    """The bank that a branch code's prefix names."""
    prefix, out = F.substr(F.upper(_value(code)), F.lit(1), F.lit(4)), F.lit("Unknown Bank")
    for k, (name, _) in BANKS.items():
        out = F.when(prefix == k, F.lit(name)).otherwise(out)
    return out


def date(x: Column, reference: Column) -> Column:
    """Calendar check, then age against the reference date (no age check if that is null)."""
    return let(_value(x), lambda v: let(_date_parts(v), lambda d: let(_on_calendar(d), lambda c: _date(v, d, c, reference))))


def _date_parts(v: Column) -> Column:
    def read(parts: Column) -> Column:
        numeric = F.rlike(v, F.lit(r"^[0-9]+[/\-.][0-9]+[/\-.][0-9]+$"))
        at = lambda i: F.when(numeric, F.get(parts, F.lit(i)).try_cast("int"))
        return let(at(2), lambda year: F.struct((F.size(parts) == 3).alias("three"), numeric.alias("numeric"), at(0).alias("day"), at(1).alias("month"), (year + F.when(year < 100, 2000).otherwise(0)).alias("year")))

    return let(F.split(v, r"[/\-.]"), read)


def _on_calendar(d: Column) -> Column:
    return F.struct(day_month_year(d["day"], d["month"], d["year"]).alias("shown"), d["month"].between(1, 12).alias("good_month"), first_of_month(d["year"], d["month"]).alias("first"))


def _date(v: Column, d: Column, c: Column, reference: Column) -> Column:
    most = F.dayofmonth(F.last_day(c["first"]))
    good = c["good_month"] & d["day"].between(1, most)
    age = F.datediff(reference, F.when(good, F.date_add(c["first"], d["day"] - 1)))
    errors = _texts(
        when(v == "", "Date field is empty"),
        when((v != "") & ~d["three"], said("Invalid date format '%s'. Expected DD/MM/YYYY", v)),
        when(d["three"] & ~d["numeric"] & (v != ""), said("Date contains non-numeric components: '%s'", v)),
        when(d["numeric"] & ~c["good_month"], said("Invalid month (%d). Must be 1-12", d["month"])),
        when(c["good_month"] & ~good, said("Invalid day (%d) for month %d/%d. Max days is %d", d["day"], d["month"], d["year"], most)),
    )
    warnings = let(age, lambda n: _texts(
        when(n > VALID_DAYS, said(f"Stale cheque: issued %d days ago on %s, exceeding {VALID_DAYS}-day validity", n, c["shown"])),
        when(n < 0, said("Post-dated cheque: dated in future on %s (relative to %s)", c["shown"], reference.cast("string"))),
    ))
    return _outcome(F.when(d["numeric"], c["shown"]).otherwise(v), errors, warnings)


def amount(x: Column) -> Column:
    number = lambda v: v.try_cast("double")
    finite = lambda n: F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)
    return let(F.replace(_value(x), F.lit(","), F.lit("")), lambda v: let(finite(number(v)), lambda n: _amount(v, n)))


def _amount(v: Column, number: Column) -> Column:
    shown = F.when(number.isNull(), v).when(F.contains(v, F.lit(".")), said("%.2f", number)).otherwise(number.cast("decimal(38,0)").cast("string"))
    errors = _texts(
        when(v == "", "Amount field is empty"),
        when((v != "") & number.isNull(), said("Amount '%s' is not a valid numeric value", v)),
        when(number <= 0, said("Amount %s must be strictly greater than zero", number.cast("string"))),
    )
    return _outcome(shown, errors, _texts(when(number >= HIGH_VALUE, said(f"High-value cheque (₹%,.2f >= ₹{HIGH_VALUE:,.2f}): Requires Positive Pay verification", number))))


def payee(x: Column) -> Column:
    return let(_value(x), _payee)


def _payee(v: Column) -> Column:
    errors = _texts(
        when(v == "", "Payee recipient name is empty"),
        when(F.length(v) == 1, said("Payee name '%s' is too short (minimum 2 characters)", v)),
        when((v != "") & (F.length(F.regexp_replace(v, r"[^\p{L}]", "")) < 2), "Payee name must contain at least 2 alphabetic characters"),
    )
    return _outcome(v, errors, _texts(when(F.upper(v).isin("SELF", "CASH"), said("Payee is designated as '%s' (Cash withdrawal instrument)", F.upper(v)))))


def tier(confidence: Column) -> Column:
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0))))
    return F.when(c >= TIER_HIGH, "HIGH").when(c >= TIER_MEDIUM, "MEDIUM").otherwise("LOW")


def low_confidence_reason(confidence: Column) -> Column:
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0))))
    return F.when(tier(confidence) == "LOW", said(f"Composite confidence %.2f falls below threshold {TIER_MEDIUM:.2f}", c))


def display_tier(confidence: Column, stored: Column) -> Column:
    """How a badge shows it: other limits than the rules'."""
    return F.when((confidence >= 0.85) | (stored == "HIGH"), "HIGH").when((confidence >= 0.70) | (stored == "MEDIUM"), "MEDIUM").otherwise("LOW")


def is_low(confidence: Column, stored: Column) -> Column:
    return (confidence < LOW_CONFIDENCE) | (stored == "LOW")


def amount_mismatch(figures: Column, words: Column) -> Column:
    """The discrepancy's text; null if they agree within one unit or either cannot be read."""
    told = "Mismatch between amount in figures (₹%,.2f) and amount in words (₹%,.2f)"
    return let(amount_of(figures), lambda a: let(words_to_number(words), lambda b: F.when(F.abs(a - b) > 1.0, said(told, a, b))))


def bank_mismatch(code: Column, bank: Column) -> Column:
    prefix, name, out = F.upper(F.substr(code, F.lit(1), F.lit(4))), F.upper(bank), F.lit(None).cast("string")
    for k, (_, known) in BANKS.items():
        fits = F.lit(False)
        for k2 in known:
            fits = fits | F.contains(name, F.lit(k2))
        out = F.when(prefix == k, F.when(~fits, said("IFSC prefix '%s' does not match bank name '%s'", prefix, bank))).otherwise(out)
    return F.when((F.length(code) >= 4) & (bank != ""), out)


def signature_missing(present: Column, confidence: Column) -> Column:
    return ~F.coalesce(present, F.lit(False)) | (F.coalesce(confidence, F.lit(0.0)) < SIGNATURE)


def reject_reason(name: Column, size: Column, w: Column, h: Column, extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "tif", "tiff", "bmp"), most_bytes: int = 15 * 1024 * 1024) -> Column:
    """Why an upload is not taken; null if it is."""
    kind = F.lower(F.substring_index(name, ".", -1))
    return F.when(~kind.isin(*extensions), "UNSUPPORTED_TYPE").when(F.coalesce(size, F.lit(0)) < 1, "EMPTY_FILE").when(size > most_bytes, "TOO_LARGE").when((w < 200) | (h < 100), "TOO_SMALL")


def propagated(detection: Column, extraction: Column) -> Column:
    """Detection to the power .3 times extraction to the power .7, each within .01 and 1."""
    within = lambda c: F.greatest(F.lit(0.01), F.least(F.lit(1.0), c))
    return F.round(F.pow(within(detection), F.lit(0.30)) * F.pow(within(extraction), F.lit(0.70)), 4)


def reliability(rule: Column, raw: Column, text: Column, valid: Column, mean: Column, least: Column, tokens: Column) -> Column:
    """struct(score, tier, review_required, reasons) of an OCR field."""
    empty, n = F.trim(F.coalesce(raw, F.lit(""))) == "", F.length(text)
    reasons = _texts(
        when(empty, "Empty OCR output"),
        when(~empty & ~valid, said("Failed domain schema validation for '%s'", rule)),
        when(~empty & (mean < TIER_MEDIUM), said(f"Low OCR mean confidence (%.2f < {TIER_MEDIUM:.2f})", mean)),
        when(~empty & (mean >= TIER_MEDIUM) & (least < 0.40) & (tokens > 1), said("Contains low-confidence token (%.2f < 0.40)", least)),
        when(~empty & (rule == "acno") & ~n.between(9, 18), said("Account number length %d outside standard [9, 18]", n)),
        when(~empty & (rule == "ifsc") & (n != 11), said("IFSC length %d != 11", n)),
        when(~empty & (rule == "ifsc") & (n == 11) & (F.substr(text, F.lit(5), F.lit(1)) != "0"), "IFSC 5th character is not '0'"),
        when(~empty & (rule == "date") & ~valid, "Invalid calendar date values"),
        when(~empty & (rule == "amount") & (text == ""), "No numerical amount extracted"),
    )
    score = F.when(empty, 0.0).otherwise((mean * 0.60 + F.when(valid, 0.40).otherwise(0.0)) * F.when(F.size(reasons) > 0, 0.85).otherwise(1.0))

    def judged(r: Column) -> Column:
        level = F.when(~empty & (r["score"] >= TIER_HIGH) & (F.size(r["reasons"]) == 0), "HIGH").when(~empty & (r["score"] >= TIER_MEDIUM) & valid, "MEDIUM").otherwise("LOW")
        return F.struct(r["score"].alias("score"), level.alias("tier"), (level == "LOW").alias("review_required"), r["reasons"].alias("reasons"))

    return let(F.struct(score.alias("score"), reasons.alias("reasons")), judged)


def failure_category(w: Column, h: Column, method: Column, predicted: Column) -> Column:
    """Why a prediction is wrong: a small image first, then the recogniser, then a miss, else what the OCR took in besides."""
    return (
        F.when((w <= 600) | (h <= 300), "poor_image_quality_low_resolution").when(method == "recognizer", "handwriting_recognition_error")
        .when(F.coalesce(predicted, F.lit("")) == "", "field_detection_miss").otherwise("ocr_background_interference")
    )
