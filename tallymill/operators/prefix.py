"""Running values over a whole order, without a window over a whole table or group.

Rows are dealt in ranges of an order by splitters that Spark draws from a sample of the rows, so the ranges hold about equally
many rows however the keys lie: a far outlier has no range of its own, and rows with one key are split by the keys after it. Only ranges are
scanned by windows; what a range has as a whole (a count, a sum, a largest value) is carried to the ranges after it, or before
it, over one row for each group and range. The dealt rows are checkpointed, for two scans of one table could draw other
splitters: executors that are lost cost nothing, and all that follows sees the same ranges.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART = "__part"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's own, else, on one machine only (as in tests), one made here."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tallymill-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def ranges(rows: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """Rows with the number of their range, in ``parts`` ranges of about equally many rows (as many as a shuffle has, else), whose
    order is ``order``. Rows alike in all of it lie in one range."""
    shared_folder(rows.sparkSession)
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id()).checkpoint()


def carried(totals: DataFrame, by: tuple[str, ...], forward: dict[str, Column], backward: dict[str, Column] | None = None) -> DataFrame:
    """(by, part) of ``totals``, one row for each group and range, with aggregates over the ranges before it (``forward``) and
    behind it (``backward``) within its group; null at the ends."""
    own = Window.partitionBy(*by).orderBy(PART)
    before, behind = own.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by).orderBy(F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, PART, *[c.over(before).alias(k) for k, c in forward.items()], *[c.over(behind).alias(k) for k, c in (backward or {}).items()])


def joined(rows: DataFrame, table: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Rows with what their group and range has; groups may be null."""
    same = F.col(PART) == F.col("__of_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    named = table.withColumnsRenamed({PART: "__of_part", **{c: f"__of_{c}" for c in by}})
    return rows.join(named, same).drop("__of_part", *[f"__of_{c}" for c in by])


def numbered(rows: DataFrame, order: list[Column], out: str, by: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Adds running numbers from 1 by ``order`` within ``by``."""
    dealt = ranges(rows, [*map(F.col, by), *order], parts)
    counts = dealt.groupBy(*by, PART).agg(F.count("*").alias("__n"))
    before = carried(counts, by, {"__before": F.sum("__n")})
    own = dealt.withColumn("__own", F.row_number().over(Window.partitionBy(*by, PART).orderBy(*order)))
    return joined(own, before, by).withColumn(out, F.col("__own") + F.coalesce("__before", F.lit(0))).drop(PART, "__own", "__before")
