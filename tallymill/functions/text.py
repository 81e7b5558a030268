"""Text expressions: white space, title case, comparison keys and error measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(x: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def title_case(x: Column) -> Column:
    """Every letter after a non-letter is upper, every other lower: O'Neil, A-B."""
    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), F.initcap), "")


def one_case(x: Column) -> Column:
    """Has letters, all of them upper or all lower."""
    return F.rlike(x, F.lit(r"\p{L}")) & ((x == F.upper(x)) | (x == F.lower(x)))


def comparison_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}./-]", "")


def exact_match(truth: Column, predicted: Column) -> Column:
    key = comparison_key(truth)
    return (key != "") & (key == comparison_key(predicted))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, after trimming and lower-casing; two empty texts are equal, one is unlike any."""
    x, y = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (a, b))
    most = F.greatest(F.length(x), F.length(y))
    return F.when(most == 0, 1.0).when(F.least(F.length(x), F.length(y)) == 0, 0.0).otherwise(1 - F.levenshtein(x, y) / most)


def character_errors(truth: Column, predicted: Column) -> Column:
    """Difference of the lengths plus mismatches at the positions that both have."""
    t, p = F.coalesce(truth, F.lit("")), F.coalesce(predicted, F.lit(""))
    pairs = F.arrays_zip(F.split(t, "").alias("t"), F.split(p, "").alias("p"))
    wrong = F.size(F.filter(pairs, lambda x: x["t"].isNotNull() & x["p"].isNotNull() & (x["t"] != "") & (x["p"] != "") & (x["t"] != x["p"])))
    return F.abs(F.length(t) - F.length(p)) + wrong
