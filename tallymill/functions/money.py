"""Amounts as text and as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def amount_of(x: Column) -> Column:
    """Digits and dots of a text as a number; null if they make none. A sign is dropped."""
    return F.nullif(F.regexp_replace(x, "[^0-9.]", ""), F.lit("")).try_cast("double")


def is_plain_number(x: Column) -> Column:
    return F.rlike(x, F.lit(r"^[0-9]+(\.[0-9]+)?$"))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Rounded percentage; 0 of nothing."""
    return F.round(F.coalesce(F.try_divide(part.cast("double") * 100, whole.cast("double")), F.lit(0.0)), digits)


def thousands(x: Column, digits: int = 2) -> Column:
    return F.format_number(x, digits)


def rupees(x: Column) -> Column:
    return F.concat(F.lit("₹"), thousands(x))


def share(a: Column, b: Column) -> Column:
    """a / b as a number, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


#: Number words and scales.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"hundred": 100, "thousand": 1000, "lakh": 100000, "lakhs": 100000, "lac": 100000, "lacs": 100000, "crore": 10000000, "crores": 10000000, "million": 1000000}
IGNORED = ("and", "rupees", "rupee", "only", "paise")
WORDS = dict(zip(UNITS, range(20))) | dict(zip(TENS, range(20, 100, 10)))


def words_to_number(words: Column) -> Column:
    """The number that words name, by folding the tokens; unknown tokens are skipped, null if nothing positive comes out."""
    literal = lambda d: F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, float(v))])
    tokens = F.filter(F.split(F.regexp_replace(F.lower(words), r"(?U)[^\w\s]", " "), r"(?U)\s+"), lambda t: (t != "") & ~t.isin(*IGNORED))
    state = lambda total, current: F.struct(total.alias("total"), current.alias("current"))

    def step(s: Column, token: Column) -> Column:
        word, scale = F.try_element_at(literal(WORDS), token), F.try_element_at(literal(SCALES), token)
        counted = F.when(s["current"] == 0, 1.0).otherwise(s["current"])
        return (
            F.when(word.isNotNull(), state(s["total"], s["current"] + word))
            .when(scale >= 1000, state(s["total"] + counted * scale, F.lit(0.0)))
            .when(scale.isNotNull(), state(s["total"], counted * scale))
            .otherwise(s)
        )

    found = F.aggregate(tokens, state(F.lit(0.0), F.lit(0.0)), step, lambda s: s["total"] + s["current"])
    return F.when(found > 0, found)
