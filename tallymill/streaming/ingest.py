"""Continuous ingest: landed rows are gated, freed of copies and appended, with review signals for outlying amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.validate import reject_reason
from ..operators.trends import fenced, signals_by

#: Size of the quantile sketches: ranks are right to about two in a thousand.
SKETCH = 2000


def landing(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of landed files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def gated(stream: DataFrame, known: DataFrame | None = None, hash_col: str = "image_hash", ts: str = "created_at", lateness: str = "1 day") -> DataFrame:
    """Rows that pass the gates, one for each hash within the watermark, none that is known already. State holds hashes for the
    lateness only."""
    rows = stream.where(reject_reason(F.col("name"), F.col("length"), F.col("width"), F.col("height")).isNull())
    rows = rows.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([hash_col])
    return rows if known is None else rows.join(known.select(hash_col).distinct(), hash_col, "left_anti")


def totals(rows: DataFrame, x: str) -> DataFrame:
    """One row of statistics that can be added to others: count, mean, squared deviations and a sketch of the quantiles."""
    v = F.col(x).cast("double")
    return rows.where(v.isNotNull() & ~F.isnan(v)).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count("*")).alias("deviations"),
        F.kll_sketch_agg_double(v, SKETCH).alias("sketch"),
    )


def added(a: DataFrame, b: DataFrame) -> DataFrame:
    """The totals of two disjoint tables as those of both."""
    apart = F.when(F.count("*") > 1, F.pow(F.max("mean") - F.min("mean"), F.lit(2)) * F.product("n") / F.sum("n")).otherwise(0.0)
    return a.unionByName(b).where("n > 0").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        (F.sum("deviations") + apart).alias("deviations"), F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch"),
    )


def statistics_of(totals_: DataFrame) -> DataFrame:
    """What signals are held against, from totals; no row below the least history."""
    at = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(p))
    enough = totals_.where("n > 0")
    return fenced(enough.select("n", "mean", F.sqrt(F.col("deviations") / F.col("n")).alias("std"), at(0.25).alias("q1"), at(0.75).alias("q3")))


def start(stream: DataFrame, documents: str, signals: str, totals_path: str, checkpoint: str, history: DataFrame | None = None, amount: str = "amount") -> StreamingQuery:
    """Appends each batch to the documents and its outliers, held against all that came before the batch, to the signals.

    Before the first batch comes ``history``, if given. A batch adds its totals to those that the batch before it left, so the
    history is not read again, and a batch costs what its own rows cost. A batch that is run again overwrites its own folders
    with the same rows, so nothing is written or counted twice."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{documents}/batch={number}")
        landed = spark.read.schema(batch.schema).parquet(f"{documents}/batch={number}")
        own = totals(landed, amount)
        if number:
            before = spark.read.schema(own.schema).parquet(f"{totals_path}/batch={number - 1}")
        else:
            before = totals(landed.limit(0) if history is None else history, amount)
        added(own, before).write.mode("overwrite").parquet(f"{totals_path}/batch={number}")
        signals_by(landed, statistics_of(before), amount).write.mode("overwrite").parquet(f"{signals}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
