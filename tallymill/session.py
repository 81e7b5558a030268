"""Session settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Methods beyond HotSpot's limit for compilation run interpreted; rules that would make such a one leave whole-stage code and
#: are generated expression by expression, in small methods.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}


def configured(spark: SparkSession) -> SparkSession:
    """UTC days and weeks; plans that adapt at run time. ANSI mode may be on or off: casts of text are all try_cast."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


#: Rows that one task is to hold at once when keys are brought together.
ROWS_A_TASK = 500_000


def dealt(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``n`` rows dealt by keys to as many tasks as that needs, for an aggregation by them: it then holds about ROWS_A_TASK keys in a
    task however large the table, and none before the shuffle, where keys that hardly repeat gain nothing. Few rows stay as they are."""
    return rows.repartition(-(-n // ROWS_A_TASK), *keys) if n > ROWS_A_TASK else rows


def spread(df: DataFrame) -> DataFrame:
    """The table in at least as many partitions as there are cores, for costly rules over a table that is stored in fewer splits;
    one that has enough is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
