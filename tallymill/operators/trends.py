"""Trends by time bucket and statistical review signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import bucket_label
from ..functions.money import amount_of, percent
from .quantiles import at_share, with_order_statistics

#: Rows that a history must have, and the signals' limits.
LEAST_HISTORY, Z_AMOUNT, IQR_TIMES, Z_HIGH, IQR_HIGH, Z_LATENCY, Z_LATENCY_MEDIUM = 10, 3.0, 2.5, 4.0, 4.0, 2.5, 3.5


def volume_trend(documents: DataFrame, interval: str = "day", ts: str = "created_at") -> DataFrame:
    flagged = F.count_if("review_required")
    made = documents.groupBy(bucket_label(F.col(ts), interval).alias("period")).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "VERIFIED").alias("verified"), flagged.alias("flagged"),
        percent(flagged, F.count("*")).alias("review_rate"), F.round(F.coalesce(F.avg("overall_confidence"), F.lit(0.0)), 4).alias("mean_confidence"),
    )
    return made.orderBy("period")


def amount_trend(documents: DataFrame, fields: DataFrame, interval: str = "day", ts: str = "created_at", value: str = "normalized_value") -> DataFrame:
    """Amounts by the time of their document. Fields without a readable amount are dropped before the join."""
    amounts = fields.select("cheque_id", amount_of(F.col(value)).alias("amount")).where("amount is not null")
    dated = documents.select(F.col("id").alias("cheque_id"), bucket_label(F.col(ts), interval).alias("period"))
    return amounts.join(dated, "cheque_id").groupBy("period").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("sum"), F.round(F.avg("amount"), 2).alias("mean")).orderBy("period")


def daily_volume(documents: DataFrame, ts: str = "created_at") -> DataFrame:
    flagged = F.count_if("review_required")
    return documents.groupBy(F.date_trunc("day", ts).alias("day")).agg(F.count("*").alias("total"), flagged.alias("flagged"), percent(flagged, F.count("*")).alias("review_rate")).orderBy("day")


def base_statistics(values: DataFrame, x: str) -> DataFrame:
    """One row: n, mean, population deviation and the quartiles at index floor(p n); no row below the least history.

    All of it takes two scans of the history, the second one for the quartiles."""
    v = F.col(x)
    made = with_order_statistics(values.where(v.isNotNull()), {"x": v}, {"x": at_share(0.25) + at_share(0.75)}, {"n": F.count("*"), "mean": F.avg(v), "std": F.stddev_pop(v)})
    return fenced(made.select("n", "mean", "std", F.col("x_0").alias("q1"), F.col("x_1").alias("q3")))


def fenced(statistics: DataFrame) -> DataFrame:
    """n, mean, std, q1 and q3 with the spread and the upper fence; no row below the least history."""
    return statistics.where(F.col("n") >= LEAST_HISTORY).withColumn("iqr", F.col("q3") - F.col("q1")).withColumn("upper", F.col("q3") + IQR_TIMES * F.col("iqr"))


def _z(x: str):
    return F.when(F.col("std") > 0, (F.col(x) - F.col("mean")) / F.col("std")).otherwise(0.0)


def amount_signals(candidates: DataFrame, history: DataFrame, x: str = "amount") -> DataFrame:
    """Candidates beyond the upper fence or the z limit of a history, with severity: a signal for review, never a verdict."""
    return signals_by(candidates, base_statistics(history, x), x)


def signals_by(candidates: DataFrame, statistics: DataFrame, x: str = "amount") -> DataFrame:
    """The same with statistics at hand. They are one row, so joining them is no growth."""
    scored = candidates.join(F.broadcast(statistics)).withColumn("z", _z(x))
    out = scored.where(((F.col(x) > F.col("upper")) & (F.col("iqr") > 0)) | (F.col("z") >= Z_AMOUNT))
    high = (F.col("z") >= Z_HIGH) | (F.col(x) > F.col("q3") + IQR_HIGH * F.col("iqr"))
    figures = [F.round(c, 2).alias(c) for c in ("mean", "std", "q1", "q3", "iqr", "upper")]
    return out.select(*candidates.columns, F.lit("AMOUNT_OUTLIER_REVIEW_SIGNAL").alias("signal_type"), F.when(high, "HIGH").otherwise("MEDIUM").alias("severity"), F.round("z", 2).alias("anomaly_score"), *figures, F.lit(False).alias("is_fraud_claim"))


def latency_signals(candidates: DataFrame, history: DataFrame, x: str = "total_latency_ms") -> DataFrame:
    scored = candidates.join(F.broadcast(base_statistics(history, x))).withColumn("z", _z(x)).where(F.col("z") >= Z_LATENCY)
    return scored.select(*candidates.columns, F.lit("LATENCY_SPIKE_REVIEW_SIGNAL").alias("signal_type"), F.when(F.col("z") < Z_LATENCY_MEDIUM, "LOW").otherwise("MEDIUM").alias("severity"), F.round("z", 2).alias("anomaly_score"), F.round("mean", 2).alias("mean"), F.round("std", 2).alias("std"))
