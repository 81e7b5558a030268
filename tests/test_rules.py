"""Field rules against worked examples."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallymill.functions import geometry, money, normalize, text, validate


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("field", "raw", "wanted", "valid"),
    [
        ("acno", "A/c No: 001401000213", "001401000213", True), ("acno", "Acc No: O30002010108841-", "030002010108841", True), ("acc_no", "No: 12345", "12345", False),
        ("ifsc", "IFSC : SYNB0003011", "SYNB0003011", True), ("ifsc_code", "RTGS/NEFT: CNRB0002854", "CNRB0002854", True), ("ifsc", "HDFCO001234", "HDFC0001234", True),
        ("date", "Date: 06/05/2022", "06/05/2022", True), ("date", "15082023", "15/08/2023", True), ("cheque_date", "25 12 2024 DDMM YYYY", "25/12/2024", True), ("date", "6/5/2022", "65/20/2022", False),
        ("date", "1/2/03", "01/02/2003", True), ("date", "31/02/2001", "31/02/2001", True), ("amount", "₹ 45,000/-", "45000", True), ("amount", "Rs. 1,250.75 /=", "1250.75", True), ("amount", "none", "", False),
        ("name", "Pay   ETHEL M. BRYSON   or Bearer", "Ethel M. Bryson", True), ("payee", "José  O'Neil", "José O Neil", True), ("amount_words", "Rupees four thousand Only /-", "Four Thousand", True),
        ("bank", "CANARA  bank*", "Canara Bank", True), ("memo", "  a \n b ", "a b", True), ("memo", None, "", False),
    ],
)
def test_normalize(spark, field, raw, wanted, valid):
    got = one(spark, normalize.normalize(F.lit(raw).cast("string"), F.lit(field)))
    assert (got["normalized_text"], got["is_valid"]) == (wanted, valid)


def test_title_case(spark):
    assert one(spark, text.title_case(F.lit("ETHEL O'NEIL a-b X2y"))) == "Ethel O'Neil A-B X2Y"


@pytest.mark.parametrize(("words", "n"), [("Four Thousand Seven Hundred and Twenty", 4720), ("One Lakh Fifty Thousand", 150000), ("eight lakhs only", 800000), ("no such number", None), ("", None), ("Crore", 10000000)])
def test_words_to_number(spark, words, n):
    assert one(spark, money.words_to_number(F.lit(words))) == n


@pytest.mark.parametrize(
    ("rule", "value", "errors", "warnings"),
    [
        (validate.account, "00140100021389", 0, 0), (validate.account, "1234ABCD567", 1, 0), (validate.account, "1234567", 1, 0), (validate.account, "1" * 20, 1, 0), (validate.account, None, 1, 0),
        (validate.branch, "CNRB0002854", 0, 0), (validate.branch, "CNRBO002854", 1, 0), (validate.branch, "SBIN001", 1, 0), (validate.branch, "12340001234", 1, 0),
        (lambda x: validate.date(x, F.lit(datetime.date(2022, 6, 1))), "15/05/2022", 0, 0), (lambda x: validate.date(x, F.lit(datetime.date(2022, 6, 1))), "01/01/2022", 0, 1),
        (lambda x: validate.date(x, F.lit(datetime.date(2022, 6, 1))), "15/08/2022", 0, 1), (lambda x: validate.date(x, F.lit(datetime.date(2022, 6, 1))), "30/02/2022", 1, 0),
        (lambda x: validate.date(x, F.lit(datetime.date(2022, 6, 1))), "01/13/2022", 1, 0), (lambda x: validate.date(x, F.lit(None).cast("date")), "29/02/24", 0, 0),
        (validate.amount, "4720.50", 0, 0), (validate.amount, "0.00", 1, 0), (validate.amount, "-500", 1, 0), (validate.amount, "750000", 0, 1), (validate.amount, "nan", 1, 0), (validate.amount, "1,000", 0, 0),
        (validate.payee, "Self", 0, 1), (validate.payee, "A", 2, 0), (validate.payee, "12", 1, 0),
    ],
)
def test_validate(spark, rule, value, errors, warnings):
    got = one(spark, rule(F.lit(value).cast("string")))
    assert (len(got["errors"]), len(got["warnings"])) == (errors, warnings), got


def test_dates_keep_zeros(spark):
    assert one(spark, validate.date(F.lit("6/5/2022"), F.lit(None).cast("date")))["value"] == "06/05/2022"


def test_cross_checks(spark):
    assert one(spark, validate.amount_mismatch(F.lit("4720"), F.lit("Four Thousand Seven Hundred and Twenty"))) is None
    assert "Mismatch" in one(spark, validate.amount_mismatch(F.lit("5000.00"), F.lit("Four Thousand Seven Hundred and Twenty")))
    assert one(spark, validate.bank_mismatch(F.lit("SYNB0001234"), F.lit("Canara Bank"))) is None
    assert "SBIN" in one(spark, validate.bank_mismatch(F.lit("SBIN0001234"), F.lit("Axis")))
    assert one(spark, validate.signature_missing(F.lit(True), F.lit(0.4)))


@pytest.mark.parametrize(("c", "t"), [(0.88, "HIGH"), (0.65, "MEDIUM"), (0.42, "LOW"), (None, "LOW")])
def test_tiers(spark, c, t):
    assert one(spark, validate.tier(F.lit(c).cast("double"))) == t


def test_propagation(spark):
    get = lambda d, e: one(spark, validate.propagated(F.lit(d), F.lit(e)))
    assert 0.85 < get(1.0, 0.90) < 0.95 and get(0.10, 0.90) < 0.60 and get(0.99, 0.20) < 0.40


def test_reliability(spark):
    r = lambda m, v: one(spark, validate.reliability(F.lit("acno"), F.lit("001401000213"), F.lit("001401000213"), F.lit(v), F.lit(m), F.lit(m), F.lit(1)))
    assert (r(0.92, True)["tier"], r(0.92, True)["review_required"]) == ("HIGH", False)
    assert (r(0.25, False)["tier"], r(0.25, False)["review_required"]) == ("LOW", True)


def test_iou(spark):
    b = lambda *v: geometry.box(*map(F.lit, v))
    assert one(spark, geometry.iou(b(0, 0, 40, 40), b(0, 0, 40, 40))) == 1
    assert one(spark, geometry.iou(b(0, 0, 10, 10), b(20, 20, 30, 30))) == 0
    assert one(spark, geometry.iou(b(0, 0, 40, 40), b(20, 0, 60, 40))) == pytest.approx(800 / 2400)
    assert tuple(one(spark, geometry.scaled(b(50, 20, 150, 60), F.lit(2), F.lit(2), F.lit(10), F.lit(20)))) == (110, 60, 310, 140)


def test_character_errors(spark):
    assert one(spark, text.character_errors(F.lit("abcd"), F.lit("abxdef"))) == 3
    assert one(spark, text.similarity(F.lit(""), F.lit(None).cast("string"))) == 1
    assert one(spark, text.similarity(F.lit("abc"), F.lit(""))) == 0
