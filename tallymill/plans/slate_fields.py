"""Field rules, review, changes and evaluation on the driver's tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geometry, money, normalize, validate
from ..functions.let import staged
from ..operators import evaluate, ledger, mutate, review, tokens
from ..operators.prefix import shared_folder
from ..session import spread
from ..streaming import ingest
from .slate import ORACLES, QUERIES, slate

# Normalisation

OUT = "normalized_text, is_valid"


def _normalized(df, key, raw, rule):
    return staged(spread(df).select(key, raw.alias("raw")), lambda: {"r": rule(F.col("raw"))}).select(key, F.col("r.normalized_text").alias("normalized_text"), F.col("r.is_valid").alias("is_valid"))


@slate(r"""SELECT c_custkey, d AS normalized_text, regexp_matches(d, '^[0-9]{9,18}$') AS is_valid FROM (SELECT c_custkey, regexp_replace(translate(regexp_replace(raw, '(?i)\b(a/c|acc|account|no|num|number)\b[:.]*', '', 'g'),
    'OoDQIl|!ZzBSsGT', '000011112285567'), '[^0-9]', '', 'g') AS d FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'A/c No: 00' WHEN 1 THEN 'Acc No: O' WHEN 2 THEN 'account number. l' ELSE '' END
    || CAST(c_custkey * 7919 + 10000 AS STRING) || CASE c_custkey % 3 WHEN 0 THEN '-S' ELSE '' END AS raw FROM customer))""")
def normalize_account(customer):
    k = F.col("c_custkey")
    head = F.when(k % 4 == 0, "A/c No: 00").when(k % 4 == 1, "Acc No: O").when(k % 4 == 2, "account number. l").otherwise("")
    return _normalized(customer, "c_custkey", F.concat(head, (k * 7919 + 10000).cast("string"), F.when(k % 3 == 0, "-S").otherwise("")), normalize.account)


@slate(r"""SELECT s_suppkey, CASE WHEN length(c) = 11 THEN translate(substr(c, 1, 4), '01258', 'OIZSB') || translate(substr(c, 5, 1), 'OQD', '000') || substr(c, 6) ELSE c END AS normalized_text,
    regexp_matches(CASE WHEN length(c) = 11 THEN translate(substr(c, 1, 4), '01258', 'OIZSB') || translate(substr(c, 5, 1), 'OQD', '000') || substr(c, 6) ELSE c END, '^[A-Z]{4}0[A-Z0-9]{6}$') AS is_valid
    FROM (SELECT s_suppkey, substr(regexp_replace(regexp_replace(upper(raw), '\b(IFSC|CODE|RTGS|NEFT|BRANCH)\b[:.]*', '', 'g'), '[^A-Z0-9]', '', 'g'), 1, 11) AS c
    FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'IFSC: HDFC' WHEN 1 THEN 'rtgs/neft: 5Y0B' ELSE 'cnr8' END || CASE s_suppkey % 4 WHEN 0 THEN 'O' WHEN 1 THEN '0' WHEN 2 THEN 'Q' ELSE 'X' END
    || CAST(s_suppkey * 37 + 100000 AS STRING) || CASE s_suppkey % 5 WHEN 0 THEN '9' ELSE '' END AS raw FROM supplier))""")
def normalize_branch(supplier):
    k = F.col("s_suppkey")
    raw = F.concat(F.when(k % 3 == 0, "IFSC: HDFC").when(k % 3 == 1, "rtgs/neft: 5Y0B").otherwise("cnr8"), F.when(k % 4 == 0, "O").when(k % 4 == 1, "0").when(k % 4 == 2, "Q").otherwise("X"), (k * 37 + 100000).cast("string"), F.when(k % 5 == 0, "9").otherwise(""))
    return _normalized(supplier, "s_suppkey", raw, normalize.branch)


@slate(r"""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN dd || '/' || mm || '/' || yyyy WHEN 1 THEN dd || '/' || mm || '/' || CASE WHEN CAST(substr(yyyy, 3, 2) AS INT) < 50 THEN '20' ELSE '19' END || substr(yyyy, 3, 2)
    ELSE dd || '/' || mm || '/' || yyyy END AS normalized_text, CAST(dd AS INT) BETWEEN 1 AND 31 AND CAST(mm AS INT) BETWEEN 1 AND 12 AND
    CAST(CASE WHEN o_orderkey % 3 = 1 AND CAST(substr(yyyy, 3, 2) AS INT) < 50 THEN '20' || substr(yyyy, 3, 2) ELSE yyyy END AS INT) BETWEEN 1990 AND 2050 AS is_valid
    FROM (SELECT o_orderkey, lpad(CAST(o_orderkey % 33 AS STRING), 2, '0') AS dd, lpad(CAST(o_orderkey % 14 AS STRING), 2, '0') AS mm, strftime(o_orderdate, '%Y') AS yyyy FROM orders)""")
def normalize_date(orders):
    k = F.col("o_orderkey")
    dd, mm, yyyy = F.lpad((k % 33).cast("string"), 2, "0"), F.lpad((k % 14).cast("string"), 2, "0"), F.date_format("o_orderdate", "yyyy")
    raw = F.when(k % 3 == 0, F.concat(F.lit("Date: "), dd, F.lit("/"), mm, F.lit("/"), yyyy)).when(k % 3 == 1, F.concat(dd, mm, F.substr(yyyy, F.lit(3), F.lit(2)), F.lit(" DDMM YYYY"))).otherwise(F.concat(F.lit("dt. "), dd, mm, yyyy))
    return _normalized(orders, "o_orderkey", raw, normalize.date)


@slate(r"""SELECT o_orderkey, n AS normalized_text, coalesce(TRY_CAST(n AS DOUBLE) > 0, FALSE) AS is_valid FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN '' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)
    || CASE o_orderkey % 4 WHEN 1 THEN '.75' ELSE '' END END AS n FROM orders)""")
def normalize_amount(orders):
    k, n = F.col("o_orderkey"), F.floor("o_totalprice")
    raw = F.when(k % 4 == 0, F.concat(F.lit("₹ "), F.format_number(n, 0), F.lit("/-"))).when(k % 4 == 1, F.concat(F.lit("Rs. "), F.format_number(n, 0), F.lit(".75 /="))).when(k % 4 == 2, F.concat(F.lit("INR "), n.cast("string"))).otherwise("= - =")
    return _normalized(orders, "o_orderkey", raw, normalize.amount)


@slate(r"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(substr(a, 1, 1)) || substr(a, 2) || ' ' || upper(substr(b, 1, 1)) || substr(b, 2) WHEN 1 THEN 'Mr. ' || a || ' ' || b ELSE upper(substr(b, 1, 1)) || substr(b, 2) END AS normalized_text,
    TRUE AS is_valid FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)""")
def normalize_payee(part):
    k, a, b = F.col("p_partkey"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    raw = F.when(k % 3 == 0, F.concat(F.lit("PAY   "), F.upper(a), F.lit(" * "), F.upper(b), F.lit(" OR BEARER"))).when(k % 3 == 1, F.concat(F.lit("Mr. "), a, F.lit("  "), b, F.lit(" A/c Payee only"))).otherwise(F.concat(b, F.lit(" or   bearer")))
    return _normalized(part, "p_partkey", raw, normalize.payee)


@slate(r"""SELECT p_partkey, upper(substr(a, 1, 1)) || substr(a, 2) || ' ' || upper(substr(b, 1, 1)) || substr(b, 2) || ' Hundred' AS normalized_text, TRUE AS is_valid
    FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)""")
def normalize_words(part):
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    raw = F.concat(F.lit("RUPEES "), F.upper(a), F.lit(" "), b, F.lit("  hundred ONLY /="))
    return _normalized(part, "p_partkey", raw, normalize.amount_words)


@slate("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'acno' WHEN 1 THEN 'amount' WHEN 2 THEN 'name' END AS rule, CASE c_custkey % 4 WHEN 0 THEN '000' || CAST(c_custkey + 100000000 AS STRING) WHEN 1 THEN CAST(c_custkey + 1 AS STRING)
    WHEN 2 THEN 'Customer ' || CAST(c_custkey AS STRING) ELSE 'x ' || CAST(c_custkey AS STRING) END AS normalized_text FROM customer""")
def normalize_by_alias(customer):
    k = F.col("c_custkey")
    field = F.when(k % 4 == 0, " Account_Number ").when(k % 4 == 1, "COURTESY_AMOUNT").when(k % 4 == 2, "payee").otherwise("memo")
    raw = F.when(k % 4 == 0, F.concat(F.lit("No: 000"), (k + 100000000).cast("string"))).when(k % 4 == 1, F.concat(F.lit("₹"), (k + 1).cast("string"))).when(k % 4 == 2, F.concat(F.lit("pay CUSTOMER "), k.cast("string"))).otherwise(F.concat(F.lit(" x   "), k.cast("string")))
    rows = customer.select("c_custkey", field.alias("field"), raw.alias("raw"))
    return rows.select("c_custkey", normalize.rule_of(F.col("field")).alias("rule"), normalize.normalize(F.col("raw"), F.col("field"))["normalized_text"].alias("normalized_text"))


@slate("""SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST((o_orderkey % 8) * 100000 + (o_orderkey % 19 + 1) * 1000 + (o_orderkey % 9 + 1) * 100 + 20 + o_orderkey % 7 AS DOUBLE) END AS amount FROM orders""")
def words_to_number(orders):
    k = F.col("o_orderkey")
    word = lambda n: F.element_at(F.array(*map(F.lit, money.UNITS)), n.cast("int") + 1)
    said = F.concat_ws(" ", word(k % 8), F.lit("Lakhs"), word(k % 19 + 1), F.lit("Thousand"), word(k % 9 + 1), F.lit("hundred and twenty-"), word(k % 7), F.lit("rupees only"))
    return spread(orders).select("o_orderkey", money.words_to_number(F.when(k % 8 == 0, "as agreed").otherwise(said)).alias("amount"))


# Validation and review

REFERENCE = "DATE '2001-01-01'"
#: Amounts in words: every fifth agrees with its figures, every fifth need not.
THOUSANDS = ("five", "ten", "fifteen", "twenty", "twenty five", "thirty", "thirty five", "forty", "forty five")
SAID = "CASE o_orderkey % 9 " + " ".join(f"WHEN {k} THEN '{w} thousand'" for k, w in enumerate(THOUSANDS)) + " END"
WIDE = """SELECT o_orderkey AS doc_id, CASE o_orderkey % 7 WHEN 0 THEN '12345' WHEN 1 THEN '12A456789' ELSE lpad(CAST(o_orderkey AS STRING), 12, '0') END AS acno,
    CASE o_orderkey % 11 WHEN 0 THEN 'SBIN001' WHEN 1 THEN 'CNRBO123456' ELSE 'CNRB0' || lpad(CAST(o_custkey % 1000000 AS STRING), 6, '0') END AS ifsc,
    CASE o_orderkey % 13 WHEN 0 THEN '30/02/2000' WHEN 1 THEN '2000' ELSE lpad(CAST(o_orderkey % 28 + 1 AS STRING), 2, '0') || '/' || lpad(CAST(o_orderkey % 12 + 1 AS STRING), 2, '0') || '/' || CAST(2000 + o_orderkey % 2 AS STRING) END AS date,
    CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 17 = 1 THEN '0' WHEN o_orderkey % 17 = 2 THEN 'abc' WHEN o_orderkey % 5 = 1 THEN CAST(5000 * (o_orderkey % 9 + 1) AS STRING)
    ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END AS amount, CASE WHEN o_orderkey % 5 < 2 THEN """ + SAID + """ END AS amt_in_words,
    CASE o_orderkey % 6 WHEN 0 THEN 'Canara Bank, Main Branch' WHEN 1 THEN 'State Bank of India' WHEN 2 THEN '' END AS bank_name,
    CASE o_orderkey % 19 WHEN 0 THEN 'A' WHEN 1 THEN 'CASH' ELSE 'Payee' END AS name, CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100 AS conf, o_orderkey % 23 > 0 AS signature_present FROM orders"""
ERRORS = {
    "acno": "CASE WHEN acno = '12A456789' THEN ['Account number contains non-numeric characters: ''12A456789'''] WHEN length(acno) < 9 THEN ['Account number length (' || length(acno) || ') is below minimum standard of 9 digits'] ELSE [] END",
    "ifsc": "CASE WHEN ifsc = 'SBIN001' THEN ['IFSC code length (7) is not exactly 11 characters'] WHEN ifsc = 'CNRBO123456' THEN ['IFSC 5th character ''O'' must be digit zero (''0'')'] ELSE [] END",
    "date": "CASE WHEN date = '2000' THEN ['Invalid date format ''2000''. Expected DD/MM/YYYY'] WHEN date = '30/02/2000' THEN ['Invalid day (30) for month 2/2000. Max days is 29'] ELSE [] END",
    "amount": "CASE WHEN amount = '' THEN ['Amount field is empty'] WHEN amount = 'abc' THEN ['Amount ''abc'' is not a valid numeric value'] WHEN amount = '0' THEN ['Amount 0.0 must be strictly greater than zero'] ELSE [] END",
    "name": "CASE WHEN name = 'A' THEN ['Payee name ''A'' is too short (minimum 2 characters)', 'Payee name must contain at least 2 alphabetic characters'] ELSE [] END",
}
AGE = "date_diff('day', TRY_CAST(substr(date, 7, 4) || '-' || substr(date, 4, 2) || '-' || substr(date, 1, 2) AS DATE), DATE '2001-01-01')"
WARNINGS = {
    "date": f"CASE WHEN len({ERRORS['date']}) > 0 THEN [] WHEN {AGE} > 90 THEN ['Stale cheque: issued ' || {AGE} || ' days ago on ' || date || ', exceeding 90-day validity'] WHEN {AGE} < 0 THEN ['Post-dated cheque: dated in future on ' || date || ' (relative to 2001-01-01)'] ELSE [] END",
    "name": "CASE WHEN name = 'CASH' THEN ['Payee is designated as ''CASH'' (Cash withdrawal instrument)'] ELSE [] END",
}
JOINED = lambda x: f"array_to_string({x}, '; ')"
FIELDS = ("acno", "ifsc", "date", "amount", "name")


@slate(f"WITH w AS ({WIDE}) SELECT doc_id, " + ", ".join(f"{JOINED(ERRORS[f])} AS {f}_errors" for f in FIELDS) + ", " + ", ".join(f"{JOINED(WARNINGS[f])} AS {f}_warnings" for f in ("date", "name")) + " FROM w")
def validate_fields(orders):
    rows = review.validate_fields(_wide(orders), reference=F.to_date(F.lit("2001-01-01")))
    text = lambda f, part: F.array_join(F.col(f"{f}_outcome")[part], "; ").alias(f"{f}_{part}")
    return rows.select("doc_id", *[text(f, "errors") for f in FIELDS], *[text(f, "warnings") for f in ("date", "name")])


def _wide(orders):
    rows = orders.sparkSession.sql(WIDE.replace("FROM orders", "FROM {orders}"), orders=spread(orders))
    return rows.withColumns({**{f"{f}_confidence": F.col("conf") for f in FIELDS}, "overall_confidence": F.col("conf"), "signature_confidence": F.when(F.col("signature_present"), 0.9).otherwise(0.0)})


LOW = "CASE WHEN conf < 0.6 THEN ['Composite confidence ' || format('{:.2f}', conf) || ' falls below threshold 0.60'] ELSE [] END"
_parts = [f"list_transform(list_concat(list_concat({ERRORS[f]}, {WARNINGS.get(f, '[]')}), {LOW}), lambda r: '[{f.upper()}] ' || r)" for f in FIELDS]
#: What fields say against each other. Figures are read where they can be, whether they are valid or not.
FIGURES, WORDS = "TRY_CAST(amount AS DOUBLE)", "CASE WHEN amt_in_words IS NOT NULL THEN CAST(5000 * (doc_id % 9 + 1) AS DOUBLE) END"
OTHER_BANK = "(ifsc LIKE 'CNRB%' AND NOT contains(upper(bank_name), 'CANARA')) OR (ifsc LIKE 'SBIN%' AND NOT contains(upper(bank_name), 'STATE BANK'))"
APART = {
    "amount": f"CASE WHEN abs({FIGURES} - {WORDS}) > 1 THEN ['Mismatch between amount in figures (₹' || format('{{:,.2f}}', {FIGURES}) || ') and amount in words (₹' || format('{{:,.2f}}', {WORDS}) || ')'] ELSE [] END",
    "bank": f"CASE WHEN bank_name <> '' AND ({OTHER_BANK}) THEN [concat('IFSC prefix ', chr(39), substr(ifsc, 1, 4), chr(39), ' does not match bank name ', chr(39), bank_name, chr(39))] ELSE [] END",
    "signature": "CASE WHEN NOT signature_present THEN ['Signature mark not detected with sufficient confidence (0.00 < 0.50)'] ELSE [] END",
}
_parts += ["CASE WHEN amount = '' THEN ['Mandatory field ''amount'' has empty value'] ELSE [] END", "CASE WHEN NOT signature_present THEN ['Signature unconfirmed in designated signatory area (confidence: 0.00)'] ELSE [] END"]
_parts += [f"list_transform({x}, lambda r: '[CONSISTENCY] ' || r)" for x in APART.values()]
REASONS = _parts[0]
for _p in _parts[1:]:
    REASONS = f"list_concat({REASONS}, {_p})"
FATAL = " + ".join(f"len({ERRORS[f]})" for f in FIELDS) + f" + CASE WHEN amount = '' THEN 1 ELSE 0 END + CASE WHEN signature_present THEN 0 ELSE 1 END + len({APART['amount']})"
TRIAGED = f"""SELECT *, CASE WHEN status = 'INVALID' THEN 'HIGH' WHEN status = 'REVIEW_REQUIRED' THEN CASE WHEN coalesce(TRY_CAST(amount AS DOUBLE), 0) >= 50000 OR len(reasons) >= 3 THEN 'HIGH' ELSE 'MEDIUM' END ELSE 'LOW' END AS priority
    FROM (SELECT *, CASE WHEN n_fatal > 0 THEN 'INVALID' WHEN len(reasons) > 0 THEN 'REVIEW_REQUIRED' WHEN conf >= 0.8 THEN 'VERIFIED' ELSE 'PROCESSED' END AS status
    FROM (SELECT *, {REASONS} AS reasons, {FATAL} AS n_fatal FROM w))"""


@slate(f"WITH w AS ({WIDE}) SELECT doc_id, status, priority, status IN ('INVALID', 'REVIEW_REQUIRED') AS review_required, conf AS overall_confidence, CAST(n_fatal AS INT) AS n_fatal, CAST(len(reasons) AS INT) AS n_reasons, {JOINED('reasons')} AS reasons FROM ({TRIAGED})")
def triage(orders):
    return review.triage(_wide(orders), F.to_date(F.lit("2001-01-01"))).withColumn("reasons", F.array_join("reasons", "; "))


@slate(f"""WITH w AS ({WIDE}) SELECT doc_id, CASE WHEN clean THEN 'ALL_GATES' ELSE 'COMPLIANCE_GATE' END AS check_type, CASE WHEN clean THEN 'VALID' WHEN status = 'REVIEW_REQUIRED' THEN 'WARNING' ELSE 'INVALID' END AS validation_status,
    clean AS is_valid, r AS validation_reason, CASE WHEN clean THEN 'LOW' ELSE priority END AS review_priority, CASE WHEN clean THEN 'ACCEPTED' ELSE 'PENDING' END AS review_resolution
    FROM (SELECT doc_id, status, priority, len(reasons) = 0 AS clean, unnest(CASE WHEN len(reasons) > 0 THEN reasons WHEN status = 'VERIFIED' THEN ['All field formats, confidence gates, and consistency checks passed successfully'] ELSE [] END) AS r FROM ({TRIAGED}))""")
def triage_rows(orders):
    return review.validation_rows(review.triage(_wide(orders), F.to_date(F.lit("2001-01-01"))))


@slate(f"WITH w AS ({WIDE}) SELECT doc_id, priority, CASE priority WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS rank FROM ({TRIAGED}) WHERE status = 'REVIEW_REQUIRED'")
def priority_queue(orders):
    return review.queue(review.triage(_wide(orders), F.to_date(F.lit("2001-01-01"))), status="REVIEW_REQUIRED").select("doc_id", "priority", "rank")


@slate(f"WITH w AS ({WIDE}) " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS \"check\", unnest({x}) AS text, {'FALSE' if k == 'bank' else 'TRUE'} AS critical FROM w" for k, x in APART.items()))
def field_discrepancies(orders):
    c = F.col
    found = staged(_wide(orders), lambda: {"d": review.discrepancies(c("amount"), c("amt_in_words"), c("ifsc"), c("bank_name"), c("signature_present"), c("signature_confidence"))})
    return found.select("doc_id", F.inline("d"))


@slate("""SELECT o_orderkey, coalesce(CASE WHEN abs(CAST(floor(o_totalprice) AS BIGINT) - 5000 * (o_orderkey % 9 + 1)) > 1 THEN 'Mismatch between amount in figures (₹' || format('{:,.2f}', CAST(floor(o_totalprice) AS DOUBLE)) ||
    ') and amount in words (₹' || format('{:,.2f}', CAST(5000 * (o_orderkey % 9 + 1) AS DOUBLE)) || ')' END, '') AS mismatch FROM orders""")
def amount_consistency(orders):
    words = F.element_at(F.array(*[F.lit(f"{w} thousand") for w in ("five", "ten", "fifteen", "twenty", "twenty five", "thirty", "thirty five", "forty", "forty five")]), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return orders.select("o_orderkey", F.coalesce(validate.amount_mismatch(F.floor("o_totalprice").cast("string"), words), F.lit("")).alias("mismatch"))


PAIRS = """SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'amount' WHEN 1 THEN 'date' ELSE 'name' END AS field_name, CAST((o_orderkey * 7) % 101 AS DOUBLE) / 100 AS det, CAST((o_orderkey * 13) % 101 AS DOUBLE) / 100 AS oc,
    CAST((o_orderkey * 29) % 101 AS DOUBLE) / 100 AS rc, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'T' || CAST(o_orderkey AS STRING) END AS ot, 'R' || CAST(o_orderkey AS STRING) AS rt, o_orderkey % 2 = 0 AS valid, o_orderkey % 11 > 0 AS has_o, o_orderkey % 4 > 0 AS has_r FROM orders"""
TIERED = "CASE WHEN {c} >= 0.8 THEN 'HIGH' WHEN {c} >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END"
FUSED = f"""SELECT *, CASE method WHEN 'recognizer' THEN rt WHEN 'hybrid' THEN CASE WHEN ot <> '' THEN ot ELSE rt END WHEN 'ocr' THEN ot ELSE '' END AS value, CASE method WHEN 'recognizer' THEN rc WHEN 'hybrid' THEN greatest(oc, rc) WHEN 'ocr' THEN oc ELSE 0.0 END AS ext
    FROM (SELECT *, has_o AND has_r AND field_name <> 'name' AS two, CASE WHEN has_o AND has_r AND field_name <> 'name' THEN CASE WHEN valid AND oc >= 0.65 THEN 'ocr' WHEN ot = '' OR rc > oc THEN 'recognizer' ELSE 'hybrid' END WHEN has_o THEN 'ocr' WHEN has_r THEN 'recognizer' ELSE 'none' END AS method FROM p)"""
PROPAGATED = "round(pow(greatest(0.01, least(1.0, {d})), 0.3) * pow(greatest(0.01, least(1.0, {e})), 0.7), 4)"


@slate(f"""WITH p AS ({PAIRS}) SELECT doc_id, field_name, value, CASE WHEN value <> '' THEN {PROPAGATED.format(d='det', e='ext')} ELSE 0.0 END AS confidence, ext AS extraction_confidence, method,
    CASE WHEN method = 'recognizer' THEN CASE WHEN two THEN {TIERED.format(c='rc')} WHEN rc >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END WHEN method = 'none' THEN 'LOW' ELSE {TIERED.format(c='oc')} END AS confidence_tier FROM ({FUSED})""")
def fuse_candidates(orders):
    p = orders.sparkSession.sql(PAIRS.replace("FROM orders", "FROM {orders}"), orders=orders)
    key = ["doc_id", "field_name"]
    detections = p.select(*key, F.col("det").alias("detection_confidence"))
    ocr = p.where("has_o").select(*key, F.col("ot").alias("text"), F.col("ot").alias("raw_text"), F.col("oc").alias("confidence"), validate.tier(F.col("oc")).alias("tier"), "valid")
    seen = p.where("has_r").select(*key, F.col("rt").alias("text"), F.col("rc").alias("confidence"), F.lit(True).alias("success"))
    return review.fuse(detections, ocr, seen).select(*key, "value", "confidence", "extraction_confidence", "method", "confidence_tier")


FIELD_ROWS = """SELECT cheque_id AS doc_id, CASE field_name WHEN 'account_number' THEN 'acno' WHEN 'cheque_number' THEN 'ifsc' WHEN 'payee_name' THEN 'name' ELSE field_name END AS field_name,
    CASE WHEN id % 6 = 0 THEN '' ELSE normalized_value END AS value, CAST(id % 11 AS DOUBLE) / 10 AS confidence, confidence_tier FROM fields_"""
EIGHTHS = FIELD_ROWS.replace("id % 11 AS DOUBLE) / 10", "id % 9 AS DOUBLE) / 8")


@slate(f"""WITH f AS ({FIELD_ROWS}), g AS (SELECT doc_id, avg(confidence) FILTER (value <> '') AS mean, count(*) FILTER (confidence_tier = 'LOW') AS low, coalesce(list_distinct(list(field_name) FILTER (value <> '' AND field_name <> 'other')), []) AS found FROM f GROUP BY doc_id),
    h AS (SELECT *, 5 - len(found) AS lost, list_sort(list_filter(['acno', 'amount', 'date', 'ifsc', 'name'], lambda x: NOT list_contains(found, x))) AS missing FROM g), o AS (SELECT *, coalesce(greatest(0.0, least(1.0, mean - 0.15 * lost)), 0.0) AS overall FROM h)
    SELECT doc_id, round(overall, 4) AS overall_confidence, CAST(lost AS INT) AS n_missing, array_to_string(missing, ',') AS missing, CASE WHEN overall >= 0.7 AND lost = 0 THEN 'SUCCESS' WHEN overall >= 0.3 THEN 'PARTIAL' ELSE 'ERROR' END AS status,
    low > 0 OR lost > 0 OR overall < 0.8 AS review_required FROM o""")
def assemble_documents(fields_):
    return review.assemble(_field_rows(fields_))


def _field_rows(fields, text=FIELD_ROWS):
    return fields.sparkSession.sql(text.replace("FROM fields_", "FROM {f}"), f=fields)


@slate(f"""WITH f AS (SELECT doc_id, field_name, max(confidence) AS confidence FROM ({EIGHTHS}) GROUP BY 1, 2) SELECT doc_id, round(avg(confidence), 4) AS overall_confidence,
    CAST(count(*) FILTER (confidence < 0.6 AND field_name <> 'other') + CASE WHEN avg(confidence) < 0.6 THEN 1 ELSE 0 END AS INT) AS n_reasons, count(*) FILTER (confidence < 0.6 AND field_name <> 'other') > 0 OR avg(confidence) < 0.6 AS review_required,
    max(CASE WHEN field_name = 'amount' THEN {TIERED.format(c='confidence')} END) AS amount_tier FROM f GROUP BY doc_id""")
def document_confidence(fields_):
    best = _field_rows(fields_, EIGHTHS).groupBy("doc_id", "field_name").agg(F.max("confidence").alias("confidence"))
    made = review.document_confidence(best)
    return made.select("doc_id", "overall_confidence", F.size("reasons").alias("n_reasons"), "review_required", F.try_element_at("tiers", F.lit("amount")).alias("amount_tier"))


@slate(f"""WITH f AS ({FIELD_ROWS}) SELECT doc_id, field_name, max(confidence) AS confidence, {TIERED.format(c='max(confidence)')} AS tier, CASE WHEN max(confidence) >= 0.85 THEN 'HIGH' WHEN max(confidence) >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS shown,
    max(confidence) < 0.7 AS is_low FROM f GROUP BY 1, 2""")
def confidence_tiers(fields_):
    best = _field_rows(fields_).groupBy("doc_id", "field_name").agg(F.max("confidence").alias("confidence"))
    c = F.col("confidence")
    return best.select("doc_id", "field_name", "confidence", validate.tier(c).alias("tier"), validate.display_tier(c, F.lit(None)).alias("shown"), F.coalesce(validate.is_low(c, F.lit("")), F.lit(False)).alias("is_low"))


@slate("""SELECT event_id, CASE WHEN m * 0.6 + CASE WHEN v THEN 0.4 ELSE 0.0 END >= 0.8 AND v AND m >= 0.6 THEN 'HIGH' WHEN v AND (m * 0.6 + 0.4) * CASE WHEN m >= 0.6 THEN 1 ELSE 0.85 END >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS tier,
    CAST(CASE WHEN v THEN 0 ELSE 1 END + CASE WHEN m < 0.6 THEN 1 ELSE 0 END AS INT) AS n_reasons FROM (SELECT event_id, CAST(event_id % 101 AS DOUBLE) / 100 AS m, event_id % 4 > 0 AS v FROM events)""")
def ocr_reliability(events):
    m, v = (F.col("event_id") % 101).cast("double") / 100, F.col("event_id") % 4 > 0
    made = events.select("event_id", validate.reliability(F.lit("general"), F.col("event_type"), F.col("event_type"), v, m, m, F.lit(1)).alias("r"))
    return made.select("event_id", F.col("r.tier").alias("tier"), F.size("r.reasons").cast("int").alias("n_reasons"))


@slate("""SELECT name, CASE WHEN NOT kind IN ('tif', 'png') THEN 'UNSUPPORTED_TYPE' WHEN size < 1 THEN 'EMPTY_FILE' WHEN size > 15728640 THEN 'TOO_LARGE' WHEN w < 200 OR h < 100 THEN 'TOO_SMALL' ELSE '' END AS reason FROM (
    SELECT 'scan' || o_orderkey || '.' || CASE o_orderkey % 3 WHEN 0 THEN 'tif' WHEN 1 THEN 'PNG' ELSE 'pdf' END AS name, CASE o_orderkey % 3 WHEN 0 THEN 'tif' WHEN 1 THEN 'png' ELSE 'pdf' END AS kind,
    (o_orderkey % 20) * 1000000 AS size, o_orderkey % 1000 AS w, o_custkey % 500 AS h FROM orders)""")
def ingest_gates(orders):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("scan"), k.cast("string"), F.lit("."), F.when(k % 3 == 0, "tif").when(k % 3 == 1, "PNG").otherwise("pdf"))
    return orders.select(name.alias("name"), F.coalesce(validate.reject_reason(name, k % 20 * 1000000, k % 1000, F.col("o_custkey") % 500), F.lit("")).alias("reason"))


@slate(f"""WITH p AS ({PAIRS}) SELECT doc_id, field_name, upper(method) || '_EXTRACTION' AS stage, CASE method WHEN 'ocr' THEN 'ocr-1' ELSE 'recognizer-1' END AS model_name, CASE WHEN method = 'none' THEN '' ELSE value END AS raw_output, ext AS raw_confidence FROM ({FUSED})""")
def prediction_rows(orders):
    p = orders.sparkSession.sql(PAIRS.replace("FROM orders", "FROM {orders}"), orders=orders)
    key = ["doc_id", "field_name"]
    ocr = p.where("has_o").select(*key, F.col("ot").alias("text"), F.col("ot").alias("raw_text"), F.col("oc").alias("confidence"), validate.tier(F.col("oc")).alias("tier"), "valid")
    seen = p.where("has_r").select(*key, F.col("rt").alias("text"), F.col("rc").alias("confidence"), F.lit(True).alias("success"))
    return review.prediction_rows(review.fuse(p.select(*key, F.col("det").alias("detection_confidence")), ocr, seen))


@slate("SELECT d.id AS doc_id, f.field_name, TRUE AS missing FROM documents_ d CROSS JOIN (VALUES ('amount'), ('date'), ('name')) f(field_name) WHERE NOT EXISTS (SELECT 1 FROM fields_ x WHERE x.cheque_id = d.id AND x.field_name = f.field_name)")
def missing_fields(documents_, fields_):
    docs = documents_.select(F.col("id").alias("doc_id"))
    there = fields_.select(F.col("cheque_id").alias("doc_id"), "field_name", F.lit(False).alias("missing"))
    return review.fill_missing(there, docs, ("amount", "date", "name")).where("missing is null").select("doc_id", "field_name", F.lit(True).alias("missing"))


@slate("SELECT cheque_id, field_name, max_by(normalized_value, id) AS value, max_by(confidence, id) AS confidence FROM fields_ GROUP BY 1, 2")
def field_maps(fields_):
    made = ledger.field_map(fields_)
    return made.select("cheque_id", F.explode("fields").alias("field_name", "v")).select("cheque_id", "field_name", F.col("v.value").alias("value"), F.col("v.confidence").alias("confidence"))


@slate("""SELECT image_id, class_id, pred_id, round_even(x * 1.5 + 10, 0) AS sx, round_even(y * 2.5 + 20, 0) AS sy, greatest(x - 8, 0.0) AS cx, least(x + w + 8, 50.0) AS cr, w * h AS area FROM (SELECT DISTINCT * FROM boxes_)""")
def box_transforms(boxes_):
    b = F.col("box")
    rows = _boxed(boxes_.distinct(), ["image_id", "class_id", "pred_id"])
    moved, cut = geometry.scaled(b, F.lit(1.5), F.lit(2.5), F.lit(10), F.lit(20)), geometry.clamped(b, F.lit(50.0), F.lit(40.0), 8)
    return rows.select("image_id", "class_id", "pred_id", moved["xmin"].alias("sx"), moved["ymin"].alias("sy"), cut["xmin"].alias("cx"), cut["xmax"].alias("cr"), geometry.area(b).alias("area"))


# Changes

KEYED = "(SELECT cheque_id, field_name, min(id) AS id, min_by(normalized_value, id) AS normalized_value, min_by(confidence, id) AS confidence, min_by(extraction_confidence, id) AS extraction_confidence FROM fields_ WHERE field_name <> 'other' GROUP BY 1, 2)"


def _keyed(fields):
    return fields.where("field_name <> 'other'").groupBy("cheque_id", "field_name").agg(F.min("id").alias("id"), *[F.min_by(c, "id").alias(c) for c in ("normalized_value", "confidence", "detection_confidence", "extraction_confidence", "extraction_method", "confidence_tier")]).withColumn("raw_value", F.col("normalized_value"))


@slate(f"""SELECT coalesce(f.cheque_id, c.cheque_id) AS cheque_id, coalesce(f.field_name, c.field_name) AS field_name, coalesce(c.value, f.normalized_value) AS normalized_value, CASE WHEN c.value IS NOT NULL THEN 1.0 ELSE f.confidence END AS confidence,
    CASE WHEN f.id IS NULL THEN 1.0 ELSE f.extraction_confidence END AS extraction_confidence, c.value IS NOT NULL AS corrected FROM {KEYED} f
    FULL JOIN (SELECT id AS cheque_id, 'date' AS field_name, 'D' || CAST(id AS STRING) AS value FROM documents_ WHERE id % 10 = 0) c ON f.cheque_id = c.cheque_id AND f.field_name = c.field_name""")
def apply_corrections(fields_, documents_):
    changes = documents_.where("id % 10 = 0").select(F.col("id").alias("cheque_id"), F.lit("date").alias("field_name"), F.concat(F.lit("D"), F.col("id").cast("string")).alias("value"))
    made = mutate.apply_corrections(_keyed(fields_), changes)
    return made.select("cheque_id", "field_name", "normalized_value", "confidence", "extraction_confidence", F.coalesce(F.col("extraction_method") == "manual_correction", F.lit(False)).alias("corrected"))


@slate("""SELECT id, CASE WHEN id % 5 = 0 THEN 'VERIFIED' ELSE status END AS status, CASE WHEN id % 5 = 0 THEN FALSE ELSE review_required END AS review_required, CASE WHEN id % 5 = 0 THEN TIMESTAMP '2002-01-01' ELSE created_at END AS updated_at FROM documents_""")
def update_status(documents_):
    docs = documents_.select("id", "status", "review_required", F.col("created_at").alias("updated_at"))
    changes = documents_.where("id % 5 = 0").select("id", F.lit("VERIFIED").alias("status"), F.lit(False).alias("review_required"))
    return mutate.update_status(docs, changes, F.lit("2002-01-01").cast("timestamp"))


@slate("""SELECT id, CASE WHEN id % 3 = 0 THEN 'CORRECTED' ELSE review_resolution END AS review_resolution, CASE WHEN id % 3 = 0 THEN 7 END AS reviewed_by_user_id FROM (SELECT DISTINCT id, review_resolution FROM checks_)""")
def resolve_reviews(checks_):
    checks = checks_.select("id", "review_resolution").distinct().withColumn("reviewed_by_user_id", F.lit(None).cast("int")).withColumn("reviewed_at", F.lit(None).cast("timestamp"))
    wanted = checks.where("id % 3 = 0").select(F.col("id").alias("id"), F.lit("CORRECTED").alias("resolution"), F.lit(7).alias("reviewer"))
    return mutate.resolve_checks(checks, wanted, F.lit("2002-01-01").cast("timestamp")).select("id", "review_resolution", "reviewed_by_user_id")


@slate("SELECT cheque_id FROM checks_ GROUP BY cheque_id HAVING bool_and(review_resolution = 'ACCEPTED')")
def promoted_documents(checks_):
    return mutate.promoted(checks_)


@slate("""SELECT cheque_id AS doc_id, CASE WHEN bool_or(id % 4 = 0) THEN 'CORRECTED' ELSE 'ACCEPTED' END AS resolution FROM fields_ GROUP BY cheque_id""")
def review_decisions(fields_):
    v = F.col("normalized_value")
    return review.decisions(fields_.select(F.col("cheque_id").alias("doc_id"), v.alias("old"), F.when(F.col("id") % 4 == 0, F.concat(v, F.lit("*"))).otherwise(v).alias("new")))


@slate("SELECT cheque_id, count(*) AS n FROM fields_ WHERE cheque_id % 9 > 0 GROUP BY cheque_id")
def cascade_delete(fields_, documents_):
    (left,) = mutate.cascade_delete(documents_.where("id % 9 = 0"), (fields_, "cheque_id"))
    return left.groupBy("cheque_id").agg(F.count("*").alias("n"))


@slate("""SELECT 'STATUS_CHANGE' AS action, 'cheque' AS resource_type, CAST(id AS STRING) AS resource_id, status AS old_status, 'VERIFIED' AS new_status FROM documents_ WHERE id % 5 = 0 AND status <> 'VERIFIED'""")
def audit_changes(documents_):
    before = documents_.select("id", "status")
    after = documents_.select(F.col("id").alias("id"), F.when(F.col("id") % 5 == 0, "VERIFIED").otherwise(F.col("status")).alias("status"))
    made = mutate.status_changes(before, after, F.lit("2002-01-01").cast("timestamp"))
    return made.select("action", "resource_type", "resource_id", F.col("details")["old_status"].alias("old_status"), F.col("details")["new_status"].alias("new_status"))


@slate("SELECT 'duplicate' AS problem, id AS key, count(*) AS n FROM fields_ GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'orphan', cheque_id, count(*) FROM runs_ WHERE cheque_id NOT IN (SELECT id FROM documents_ WHERE id % 2 = 0) GROUP BY cheque_id")
def integrity(fields_, runs_, documents_):
    twice = mutate.duplicates_of_key(fields_, "id").select(F.lit("duplicate").alias("problem"), F.col("id").alias("key"), "n")
    lost = mutate.orphans(runs_, "cheque_id", documents_.where("id % 2 = 0")).groupBy(F.col("cheque_id").alias("key")).agg(F.count("*").alias("n"))
    return twice.unionByName(lost.withColumn("problem", F.lit("orphan")))


# Evaluation


@slate("""SELECT CAST(t AS INT) AS truth, CAST(p AS INT) AS predicted, CAST(coalesce(n, 0) AS BIGINT) AS n FROM range(10) a(t) CROSS JOIN range(10) b(p) LEFT JOIN (SELECT truth, predicted, count(*) AS n FROM classified_ GROUP BY 1, 2) c ON c.truth = t AND c.predicted = p""")
def confusion_matrix(classified_):
    return evaluate.confusion_matrix(classified_, 10)


METRICS = """(SELECT c AS class, support, tp, named - tp AS fp, support - tp AS fn, round(coalesce(p, 0), 4) AS precision, round(coalesce(r, 0), 4) AS recall, round(coalesce(2 * coalesce(p, 0) * coalesce(r, 0) / nullif(coalesce(p, 0) + coalesce(r, 0), 0), 0), 4) AS f1 FROM (
    SELECT *, tp / nullif(CAST(named AS DOUBLE), 0) AS p, tp / nullif(CAST(support AS DOUBLE), 0) AS r FROM (SELECT CAST(k AS INT) AS c, count(*) FILTER (truth = k) AS support, count(*) FILTER (truth = k AND predicted = k) AS tp,
    count(*) FILTER (predicted = k) AS named FROM range(10) g(k) CROSS JOIN classified_ GROUP BY k)))"""


@slate(f"SELECT * FROM {METRICS}")
def class_metrics(classified_):
    return evaluate.class_metrics(evaluate.confusion_matrix(classified_, 10))


@slate(f"""SELECT * FROM (SELECT count(*) AS n, round(count(*) FILTER (truth = predicted) / CAST(count(*) AS DOUBLE), 4) AS accuracy FROM classified_) CROSS JOIN
    (SELECT round(avg(precision), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall, round(avg(f1), 4) AS macro_f1, round(sum(f1 * support) / sum(support), 4) AS weighted_f1 FROM {METRICS} WHERE support > 0)""")
def macro_metrics(classified_):
    return evaluate.macro_metrics(classified_, evaluate.class_metrics(evaluate.confusion_matrix(classified_, 10)))


@slate("SELECT truth, predicted, count(*) AS n FROM classified_ WHERE truth <> predicted AND truth BETWEEN 0 AND 9 AND predicted BETWEEN 0 AND 9 GROUP BY 1, 2 ORDER BY n DESC, truth, predicted LIMIT 10")
def confusing_pairs(classified_):
    return evaluate.confusing_pairs(evaluate.confusion_matrix(classified_, 10))


@slate("SELECT ordinal, truth, predicted, confidence, truth <> predicted AS incorrect, confidence < 0.7 AS low_confidence FROM classified_ WHERE truth <> predicted OR confidence < 0.7")
def error_cases(classified_):
    return evaluate.error_cases(classified_)


KEY = "regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}./-]', '', 'g')"
SCORED = f"""(SELECT *, a = b AND a <> '' AS exact, CASE WHEN a = '' AND b = '' THEN 1.0 WHEN a = '' OR b = '' THEN 0.0 ELSE 1 - CAST(levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b)) END AS similarity,
    abs(length(a) - length(b)) + len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[i] <> b[i])) AS char_errors, greatest(length(a), 1) AS chars FROM (SELECT *, {KEY.format(c='truth')} AS a, {KEY.format(c='predicted')} AS b FROM texts_))"""


@slate(f"SELECT doc_id, exact, round(similarity, 6) AS similarity, CAST(char_errors AS INT) AS char_errors FROM {SCORED}")
def text_similarity(texts_):
    return evaluate.scored(texts_).select("doc_id", "exact", F.round("similarity", 6).alias("similarity"), F.col("char_errors").cast("int").alias("char_errors"))


@slate(f"SELECT field, count(*) AS n, round(avg(CASE WHEN predicted <> '' THEN 1.0 ELSE 0.0 END), 4) AS presence_rate, round(avg(CASE WHEN exact THEN 1.0 ELSE 0.0 END), 4) AS exact_rate, round(avg(similarity), 4) AS mean_similarity FROM {SCORED} GROUP BY field")
def extraction_accuracy(texts_):
    return evaluate.extraction_accuracy(evaluate.scored(texts_))


@slate(f"""SELECT n, round(e, 4) AS exact_match, round(1 - e, 4) AS wer, round(c, 4) AS cer, round(1 - c, 4) AS char_accuracy FROM (SELECT count(*) AS n, count(*) FILTER (exact) / CAST(count(*) AS DOUBLE) AS e,
    least(1.0, CAST(sum(char_errors) AS DOUBLE) / sum(chars)) AS c FROM {SCORED})""")
def text_error_rates(texts_):
    return evaluate.text_error_rates(evaluate.scored(texts_))


@slate(f"""SELECT category, CAST(n AS BIGINT) AS n FROM (SELECT count(*) FILTER (w > 600 AND h > 300 AND method = 'recognizer') AS handwriting_recognition_error, count(*) FILTER (w <= 600 OR h <= 300) AS poor_image_quality_low_resolution,
    count(*) FILTER (w > 600 AND h > 300 AND method <> 'recognizer' AND predicted = '') AS field_detection_miss, count(*) FILTER (w > 600 AND h > 300 AND method <> 'recognizer' AND predicted <> '') AS ocr_background_interference,
    count(*) FILTER (confidence < 0.6) AS low_confidence_review_trigger FROM {SCORED} WHERE NOT exact) UNPIVOT (n FOR category IN (handwriting_recognition_error, poor_image_quality_low_resolution, field_detection_miss, ocr_background_interference, low_confidence_review_trigger))""")
def failure_modes(texts_):
    return evaluate.failure_modes(evaluate.scored(texts_), F.col("w"), F.col("h"), F.col("method"), F.col("confidence"))


def _boxed(df, keep):
    x, y, w, h = (F.col(c) for c in "xywh")
    return df.select(*keep, geometry.box(x, y, x + w, y + h).alias("box"))


#: All ten of mAP@[.50:.95].
THRESHOLDS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
TEN = "(VALUES " + ", ".join(f"({t})" for t in THRESHOLDS) + ")"
UNIQUE_BOXES = "(SELECT DISTINCT * FROM boxes_)"
UNIQUE_TRUTHS = "(SELECT DISTINCT * FROM truths_)"
BEST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, pred_id) AS n FROM {UNIQUE_BOXES}) WHERE n = 1)"
IW, IH = "greatest(least(p.x + p.w, t.x + t.w) - greatest(p.x, t.x), 0)", "greatest(least(p.y + p.h, t.y + t.h) - greatest(p.y, t.y), 0)"
MATCHED = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, class_id, pred_id ORDER BY iou DESC, truth_id) AS n FROM (SELECT p.image_id, p.class_id, p.pred_id, p.score, t.truth_id,
    coalesce({IW} * {IH} / nullif(p.w * p.h + t.w * t.h - {IW} * {IH}, 0), 0) AS iou FROM {UNIQUE_BOXES} p LEFT JOIN {UNIQUE_TRUTHS} t ON p.image_id = t.image_id AND p.class_id = t.class_id)) WHERE n = 1)"""
HITS = f"""(SELECT *, CASE WHEN enough AND row_number() OVER (PARTITION BY threshold, class_id, image_id, truth_id, enough ORDER BY score DESC, pred_id) = 1 THEN 1 ELSE 0 END AS tp FROM (
    SELECT m.*, threshold, truth_id IS NOT NULL AND iou >= threshold AS enough FROM {MATCHED} m CROSS JOIN {TEN} v(threshold)))"""
AP = f"""(SELECT class_id, threshold, round(coalesce(sum((recall - lr) * (envelope + le) / 2), 0), 6) AS ap FROM (SELECT *, lag(recall) OVER (PARTITION BY class_id, threshold ORDER BY k) AS lr, lag(envelope) OVER (PARTITION BY class_id, threshold ORDER BY k) AS le FROM (
    SELECT *, max(precision) OVER (PARTITION BY class_id, threshold ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM (
    SELECT h.class_id, threshold, row_number() OVER o AS k, CAST(sum(tp) OVER o AS DOUBLE) / truths AS recall, CAST(sum(tp) OVER o AS DOUBLE) / row_number() OVER o AS precision FROM {HITS} h JOIN (SELECT class_id, count(*) AS truths FROM {UNIQUE_TRUTHS} GROUP BY 1) n ON n.class_id = h.class_id
    WINDOW o AS (PARTITION BY h.class_id, threshold ORDER BY score DESC, image_id, pred_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    UNION ALL SELECT class_id, threshold, k, r, 0.0 FROM (SELECT DISTINCT class_id FROM truths_) CROSS JOIN {TEN} v(threshold) CROSS JOIN (VALUES (0, 0.0), (2147483647, 1.0)) e(k, r)))) GROUP BY 1, 2)"""


def _evaluated(boxes, truths):
    p = _boxed(boxes.distinct(), ["image_id", "class_id", "pred_id", "score"])
    t = _boxed(truths.distinct(), ["image_id", "class_id", "truth_id"])
    return evaluate.matches(p, t), t


@slate(f"SELECT image_id, class_id, pred_id, score FROM {BEST}")
def best_boxes(boxes_):
    return evaluate.best_boxes(boxes_.distinct().withColumn("ordinal", F.col("pred_id"))).select("image_id", "class_id", "pred_id", "score")


@slate(f"SELECT image_id, class_id, pred_id, truth_id, round(iou, 6) AS iou FROM {MATCHED}")
def box_matches(boxes_, truths_):
    return _evaluated(boxes_, truths_)[0].select("image_id", "class_id", "pred_id", "truth_id", F.round("iou", 6).alias("iou"))


DETECTED = f"""SELECT class_id, truths, CAST(predictions AS BIGINT) AS predictions, CAST(tp AS BIGINT) AS tp, CAST(predictions - tp AS BIGINT) AS fp, CAST(truths - tp AS BIGINT) AS fn, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM (
    SELECT *, coalesce(tp / nullif(CAST(predictions AS DOUBLE), 0), 0) AS p, coalesce(tp / CAST(truths AS DOUBLE), 0) AS r FROM (SELECT n.class_id, truths, coalesce(predictions, 0) AS predictions, coalesce(tp, 0) AS tp FROM (SELECT class_id, count(*) AS truths FROM {UNIQUE_TRUTHS} GROUP BY 1) n
    LEFT JOIN (SELECT class_id, count(*) AS predictions, sum(tp) AS tp FROM {HITS} WHERE threshold = 0.5 GROUP BY 1) h ON h.class_id = n.class_id))"""


@slate(DETECTED)
def detection_metrics(boxes_, truths_):
    matched, t = _evaluated(boxes_, truths_)
    return evaluate.detection_metrics(evaluate.hits(matched, THRESHOLDS), t)


@slate(f"SELECT class_id, CAST(threshold AS DOUBLE) AS threshold, ap FROM {AP}")
def average_precision(boxes_, truths_):
    matched, t = _evaluated(boxes_, truths_)
    return evaluate.average_precision(matched, t, THRESHOLDS)


@slate(f"SELECT round(avg(ap) FILTER (threshold = 0.5), 4) AS map_50, round(avg(ap), 4) AS map_50_95 FROM {AP}")
def mean_average_precision(boxes_, truths_):
    return evaluate.mean_average_precision(average_precision(boxes_, truths_))


@slate("SELECT field_id, string_agg(text, ' ' ORDER BY line_num, word_num, text) AS text, round(avg(conf), 4) AS mean_confidence, round(min(conf), 4) AS min_confidence, count(*) AS tokens FROM tokens_ GROUP BY field_id")
def token_rollup(tokens_):
    return tokens.token_rollup(tokens_)


@slate("SELECT user_id AS field_id, string_agg(substr(event_type, 1, 1), '' ORDER BY event_id, substr(event_type, 1, 1)) AS text, round(avg(value), 4) AS mean_confidence FROM events GROUP BY user_id")
def glyph_rollup(events):
    return tokens.glyph_rollup(events.select(F.col("user_id").alias("field_id"), F.col("event_id").alias("x"), F.substr("event_type", F.lit(1), F.lit(1)).alias("label"), F.col("value").alias("conf")))


@slate("""SELECT field_id, array_to_string(list_reduce(list([x] ORDER BY x), lambda kept, b: CASE WHEN b[1] > kept[-1] + 3 THEN kept || b ELSE kept END), ',') AS kept
    FROM (SELECT l_orderkey AS field_id, CAST(l_partkey % 60 AS INT) AS x FROM lineitem) GROUP BY field_id""")
def glyph_deoverlap(lineitem):
    rows = lineitem.select(F.col("l_orderkey").alias("field_id"), (F.col("l_partkey") % 60).cast("int").alias("x"), F.lit(5).alias("w"))
    return tokens.deoverlapped(rows).select("field_id", F.array_join(F.transform("kept", lambda b: b["x"].cast("string")), ",").alias("kept"))


#: Landed copies have equal hashes. What their events share is told, for which copy comes first is not determined.
INGESTED = """SELECT sha256(concat_ws('-', user_id, CAST(floor(value) AS BIGINT))) AS image_hash, user_id, CAST(floor(value) AS BIGINT) AS whole_amount, 1::BIGINT AS n
    FROM events WHERE event_id IS NOT NULL AND event_id % 9 * 2000000 BETWEEN 1 AND 15728640 GROUP BY ALL"""


def ingest_stream(spark, sf_dir):
    """Events as landed files, streamed to their end: gates, copies dropped within the watermark, appended with signals. The SQL
    tells the rows where all events land within one batch, as in the driver's tables."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # a file or a folder of parts
    raw = ingest.landing(spark, f"{sf_dir}/events.parquet*", schema)
    landed = raw.select(
        F.concat(F.col("event_id").cast("string"), F.lit(".tif")).alias("name"), (F.col("event_id") % 9 * 2000000).alias("length"),
        F.lit(800).alias("width"), F.lit(400).alias("height"), F.sha2(F.concat_ws("-", "user_id", F.floor("value").cast("string")), 256).alias("image_hash"),
        F.col("ts").alias("created_at"), F.col("value").alias("amount"), "user_id",
    )
    query = ingest.start(ingest.gated(landed), f"{folder}/documents", f"{folder}/signals", f"{folder}/totals", f"{folder}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/documents").groupBy("image_hash", "user_id", F.floor("amount").alias("whole_amount")).agg(F.count("*").alias("n"))


QUERIES["ingest_stream"] = ingest_stream
ORACLES["ingest_stream"] = INGESTED
