"""Trends that are kept up to date from changes, instead of being worked out anew from all rows.

A change of a row takes what the row was out of a small table of sums and adds what it is: an insert has no row before, a delete
none after. Counts and sums are kept by day and facet; sums are decimals, so what is taken out is exactly what was put in, and
a mean is a quotient of two sums. Trends by day or week, shares and pass rates follow from the kept sums alone.

The sums after each batch are a table of their own, made from those after the batch before, so a batch that is run again gives
the same sums; nothing is added twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import bucket_label
from ..functions.money import amount_of, percent

SUM = "decimal(38,12)"


def document_facets() -> tuple[dict[str, Column], dict[str, Column]]:
    confidence = F.col("overall_confidence")
    return {"day": F.to_date("created_at"), "status": F.col("status")}, {"flagged": F.coalesce(F.col("review_required").cast("int"), F.lit(0)), "confidence": F.coalesce(confidence, F.lit(0.0)), "confidences": confidence.isNotNull().cast("int")}


def amount_facets(value: str = "normalized_value", ts: str = "created_at") -> tuple[dict[str, Column], dict[str, Column]]:
    """Of amount fields with the time of their document; a value that cannot be read counts as no amount."""
    x = amount_of(F.col(value))
    return {"day": F.to_date(ts)}, {"amount": F.coalesce(x, F.lit(0.0)), "amounts": x.isNotNull().cast("int")}


def check_facets() -> tuple[dict[str, Column], dict[str, Column]]:
    return {"check_type": F.col("check_type")}, {"valid": F.coalesce(F.col("is_valid").cast("int"), F.lit(0))}


def contributions(rows: DataFrame, facets: tuple[dict[str, Column], dict[str, Column]], sign: int = 1) -> DataFrame:
    """The sums of rows by their facets, each times ``sign``."""
    keys, sums = facets
    made = rows.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count("*").alias("n"), *[F.sum(c.cast(SUM)).alias(k) for k, c in sums.items()])
    return made.select(*keys, (F.col("n") * sign).alias("n"), *[(F.col(k) * sign).cast(SUM).alias(k) for k in sums])


def added(parts: list[DataFrame], facets: tuple[dict[str, Column], dict[str, Column]]) -> DataFrame:
    """Sums of several tables of sums; a facet without rows goes."""
    keys, sums = facets
    whole = reduce(DataFrame.unionByName, parts)
    made = whole.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(k).cast(SUM).alias(k) for k in sums])
    return made.where("n <> 0")


def changed(sums: DataFrame, before: DataFrame, after: DataFrame, facets: tuple[dict[str, Column], dict[str, Column]]) -> DataFrame:
    """The sums once rows ``before`` have become rows ``after``: all versions of the changed rows, old and new, whatever their number."""
    return added([sums, contributions(before, facets, -1), contributions(after, facets)], facets)


class Kept:
    """Sums kept in a folder, a table a batch."""

    def __init__(self, spark: SparkSession, path: str, facets: tuple[dict[str, Column], dict[str, Column]]):
        self.spark, self.path, self.facets = spark, path, facets

    def at(self, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/batch={batch}")

    def start(self, rows: DataFrame) -> DataFrame:
        """Batch 0: everything there is."""
        contributions(rows, self.facets).write.mode("overwrite").parquet(f"{self.path}/batch=0")
        return self.at(0)

    def apply(self, batch: int, before: DataFrame, after: DataFrame) -> DataFrame:
        """The next batch, or one that is run again."""
        changed(self.at(batch - 1), before, after, self.facets).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return self.at(batch)


def volume_trend(sums: DataFrame, interval: str = "day") -> DataFrame:
    """As over the documents themselves, from their kept sums."""
    n = F.sum("n")
    flagged, confidences = F.sum("flagged").cast("long"), F.sum("confidences").cast("long")
    mean = F.when(confidences > 0, (F.sum("confidence").cast("double") / confidences)).otherwise(0.0)
    verified = F.coalesce(F.sum(F.when(F.col("status") == "VERIFIED", F.col("n"))), F.lit(0))
    made = sums.groupBy(bucket_label(F.col("day").cast("timestamp_ntz"), interval).alias("period"))
    return made.agg(n.alias("total"), verified.alias("verified"), flagged.alias("flagged"), percent(flagged, n).alias("review_rate"), F.round(mean, 4).alias("mean_confidence")).orderBy("period")


def amount_trend(sums: DataFrame, interval: str = "day") -> DataFrame:
    n, x = F.sum("amounts").cast("long"), F.sum("amount").cast("double")
    made = sums.groupBy(bucket_label(F.col("day").cast("timestamp_ntz"), interval).alias("period")).agg(n.alias("n"), F.round(x, 2).alias("sum"), F.round(F.try_divide(x, n), 2).alias("mean"))
    return made.where("n > 0").orderBy("period")


def by_status(sums: DataFrame) -> DataFrame:
    counted = sums.groupBy("status").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(total).select("status", "n", percent(F.col("n"), F.col("total")).alias("share")).orderBy(F.desc("n"), "status")


def validation_by_type(sums: DataFrame) -> DataFrame:
    valid = F.col("valid").cast("long")
    return sums.select("check_type", F.col("n").alias("total"), valid.alias("valid"), (F.col("n") - valid).alias("invalid"), percent(valid, F.col("n")).alias("pass_rate")).orderBy(F.desc("total"), "check_type")
