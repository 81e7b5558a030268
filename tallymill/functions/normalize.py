"""Normalisation of extracted field texts as column expressions.

Each function takes the raw text and returns a struct: normalized_text, is_valid, steps (what changed it, in order). Null
text is treated as empty. Digits are ASCII digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let
from .text import collapse, one_case, title_case

#: Letters read for digits and digits read for letters.
LETTERS, AS_DIGITS = "OoDQIl|!ZzBSsGT", "000011112285567"
DIGITS, AS_LETTERS = "01258", "OIZSB"
#: Label, guide and filler patterns of each field, and the aliases that name its rule.
ACCOUNT_LABELS = r"(?iU)\b(a/c|acc|account|no|num|number)\b[:.]*"
BRANCH_LABELS = r"(?iU)\b(ifsc|code|rtgs|neft|branch)\b[:.]*"
DATE_LABELS = r"(?iU)\b(date|dt|dated)\b[:.]*"
DATE_GUIDES = (r"(?iU)\b[d\s]{1,4}[m\s]{1,4}[y\s]{1,8}\b", r"(?iU)ddmm\s*y*")
CURRENCY = r"(?i)[₹$€£]|rs\.?|inr|/-|/=|="
PAYEE_FILLERS = (r"(?iU)^\s*pay\b", r"(?iU)^\s*self\b", r"(?iU)\bor\s+bearer\b", r"(?iU)\ba/c\s+payee\b", r"(?iU)\baccount\s+payee\b", r"(?iU)\bonly\b", r"[*#~|]+")
WORDS_FILLERS = (r"(?iU)\brupees\b", r"(?iU)\bonly\b", r"[*#~|/=-]+")
ALIASES = {
    "acno": ("acno", "account_number", "acc_no"),
    "ifsc": ("ifsc", "ifsc_code"),
    "date": ("date", "cheque_date"),
    "amount": ("amount", "amt_in_figures", "courtesy_amount"),
    "name": ("name", "payee_name", "payee"),
    "amt_in_words": ("amt_in_words", "legal_amount", "amount_words"),
    "bank_name": ("bank_name", "bank"),
}


def _result(text: Column, valid: Column, *steps: tuple[Column | None, str]) -> Column:
    none = F.array().cast("array<string>")
    told = F.concat(none, *[F.array(F.lit(name)) if when is None else F.when(when, F.array(F.lit(name))).otherwise(none) for when, name in steps])
    return F.struct(text.alias("normalized_text"), F.coalesce(valid, F.lit(False)).alias("is_valid"), told.alias("steps"))


def _raw(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def account(raw: Column) -> Column:
    bare = F.regexp_replace(_raw(raw), ACCOUNT_LABELS, "")
    mapped = F.translate(bare, LETTERS, AS_DIGITS)
    digits = F.regexp_replace(mapped, "[^0-9]", "")
    return _result(digits, F.rlike(digits, F.lit("^[0-9]{9,18}$")), (bare != _raw(raw), "label_removed"), (mapped != bare, "letters_to_digits"), (None, "digits_kept"))


def branch(raw: Column) -> Column:
    upper = F.upper(_raw(raw))
    bare = F.regexp_replace(upper, BRANCH_LABELS, "")
    code = F.substr(F.regexp_replace(bare, "[^A-Z0-9]", ""), F.lit(1), F.lit(11))
    bank, fifth, rest = F.substr(code, F.lit(1), F.lit(4)), F.substr(code, F.lit(5), F.lit(1)), F.substr(code, F.lit(6))
    mended_bank, mended_fifth = F.translate(bank, DIGITS, AS_LETTERS), F.translate(fifth, "OQD", "000")
    full = F.length(code) == 11
    out = F.when(full, F.concat(mended_bank, mended_fifth, rest)).otherwise(code)
    steps = (bare != upper, "label_removed"), (None, "punctuation_removed"), (full & (mended_bank != bank), "bank_letters_mended"), (full & (mended_fifth != fifth), "zero_mended")
    return _result(out, F.rlike(out, F.lit("^[A-Z]{4}0[A-Z0-9]{6}$")), *steps)


def date(raw: Column) -> Column:
    """Eight digits, else six, else the first delimited date; the range check knows no calendar."""
    bare = F.trim(F.regexp_replace(_raw(raw), DATE_LABELS, " "))
    clean = bare
    for guide in DATE_GUIDES:
        clean = F.regexp_replace(clean, guide, " ")
    return let(F.struct(bare.alias("bare"), clean.alias("clean"), F.regexp_replace(clean, "[^0-9]", "").alias("digits")), lambda t: let(_made(t["clean"], t["digits"]), lambda made: _dated(raw, t, made)))


def _made(clean: Column, digits: Column) -> Column:
    part = lambda at, n: F.substr(digits, F.lit(at), F.lit(n))
    n, delimited = F.length(digits), r"([0-9]{1,2})[/\-.]([0-9]{1,2})[/\-.]([0-9]{2,4})"
    group = lambda k: F.regexp_extract(clean, delimited, k)
    century = F.when(part(5, 2).try_cast("int") < 50, "20").otherwise("19")
    year = F.when(F.length(group(3)) == 4, group(3)).otherwise(F.concat(F.lit("20"), group(3)))
    slash = F.lit("/")
    return (
        F.when(n == 8, F.concat(part(1, 2), slash, part(3, 2), slash, part(5, 4)))
        .when(n == 6, F.concat(part(1, 2), slash, part(3, 2), slash, century, part(5, 2)))
        .when(group(1) != "", F.concat(F.lpad(group(1), 2, "0"), slash, F.lpad(group(2), 2, "0"), slash, year))
        .otherwise("")
    )


def _dated(raw: Column, t: Column, made: Column) -> Column:
    n = F.length(t["digits"])
    at = lambda i: F.try_element_at(F.split(made, "/"), F.lit(i)).try_cast("int")
    valid = at(1).between(1, 31) & at(2).between(1, 12) & at(3).between(1990, 2050)
    steps = (t["clean"] != t["bare"], "guides_removed"), (n == 8, "eight_digits"), (n == 6, "six_digits"), (~n.isin(6, 8) & (made != ""), "delimited")
    return _result(F.when(made != "", made).otherwise(F.trim(raw)), valid, *steps)


def amount(raw: Column) -> Column:
    bare = F.regexp_replace(_raw(raw), CURRENCY, "")
    number = F.regexp_extract(F.regexp_replace(bare, r"(?U)[\s,*#_]", ""), r"[0-9]+(\.[0-9]{1,2})?", 0)
    return _result(number, number.try_cast("double") > 0, (bare != _raw(raw), "currency_removed"), (number != "", "number_found"))


def payee(raw: Column) -> Column:
    bare = _raw(raw)
    for filler in PAYEE_FILLERS:
        bare = F.regexp_replace(bare, filler, " ")
    name = collapse(F.regexp_replace(bare, r"(?U)[^\w\s.\-]", " "))
    out = F.when(one_case(name), title_case(name)).otherwise(name)
    return _result(out, F.rlike(out, F.lit("[A-Za-z]{2,}")), (bare != _raw(raw), "fillers_removed"), (None, "white_space_collapsed"), (one_case(name), "title_case"))


def amount_words(raw: Column) -> Column:
    bare = _raw(raw)
    for filler in WORDS_FILLERS:
        bare = F.regexp_replace(bare, filler, " ")
    out = title_case(collapse(F.regexp_replace(bare, r"(?U)[^\w\s\-]", " ")))
    return _result(out, F.rlike(out, F.lit("[A-Za-z]")), (bare != _raw(raw), "fillers_removed"), (None, "title_case"))


def bank_name(raw: Column) -> Column:
    out = title_case(collapse(F.regexp_replace(_raw(raw), r"(?U)[^\w\s.\-&]", " ")))
    return _result(out, F.length(out) >= 3, (None, "punctuation_removed"))


def general(raw: Column) -> Column:
    out = collapse(_raw(raw))
    return _result(out, F.length(out) > 0, (None, "white_space_collapsed"))


def _once(rule: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda raw: let(_raw(raw), rule)


account, branch, date, amount, payee, amount_words, bank_name, general = map(_once, (account, branch, date, amount, payee, amount_words, bank_name, general))
RULES: dict[str, Callable[[Column], Column]] = {"acno": account, "ifsc": branch, "date": date, "amount": amount, "name": payee, "amt_in_words": amount_words, "bank_name": bank_name}


def rule_of(field: Column) -> Column:
    """The rule that a field's alias names; null for general text."""
    name, out = F.lower(F.trim(field)), F.lit(None).cast("string")
    for rule, aliases in ALIASES.items():
        out = F.when(name.isin(*aliases), F.lit(rule)).otherwise(out)
    return out


def normalize(raw: Column, field: Column) -> Column:
    """The struct of the rule that the field's name picks."""
    rule, out = rule_of(field), general(raw)
    for name, make in RULES.items():
        out = F.when(rule == name, make(raw)).otherwise(out)
    return out


def account_facts(text: Column) -> Column:
    """struct(leading_zero, n_digits) of a normalised account number."""
    return F.struct(F.coalesce(F.startswith(text, F.lit("0")), F.lit(False)).alias("leading_zero"), F.coalesce(F.length(text), F.lit(0)).alias("n_digits"))


def branch_parts(code: Column) -> Column:
    """struct(bank, branch) of a normalised branch code, null parts unless it has all eleven characters."""
    whole = F.length(code) == 11
    return F.struct(F.when(whole, F.substr(code, F.lit(1), F.lit(4))).alias("bank"), F.when(whole, F.substr(code, F.lit(6))).alias("branch"))


def distinct_steps(*steps: Column) -> Column:
    """All steps of several rules, each once, in the order of its first use."""
    return F.array_distinct(F.concat(F.array().cast("array<string>"), *steps))
