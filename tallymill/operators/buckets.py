"""Stored tables that are changed in place, bucket by bucket.

A table lies in a bounded number of folders by a hash of its key. A batch of changes is routed to the buckets of its keys; only
these are read, merged and replaced, each as a whole once all are written, and the files of the others are left alone. A key has one
row, which is checked before anything is replaced.

A batch has a number. The numbers of those that are done are kept beside the data, so one that comes again changes nothing. One that
was lost half-way has replaced some buckets by what they are to be, and finds the same when it is run again, for a change sets
values and does not add to them. One writer changes a table at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ROWS_A_TASK, dealt
from .mutate import last_changes

BUCKET, DELETED, NAMED = "bucket", "deleted", "named"


class Buckets:
    """A table of ``schema`` with one row for each ``key``, in ``buckets`` folders under ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def stored(self) -> DataFrame:
        """All rows with their bucket, which prunes folders; none before the first batch."""
        whole = StructType([*self.schema.fields, *self.spark.range(0).select(F.lit(0).alias(BUCKET)).schema.fields])
        if not self.done():
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(f"{self.path}/data")

    def rows(self) -> DataFrame:
        return self.stored().drop(BUCKET)

    def done(self) -> set[int]:
        """Numbers of the batches that are in the table."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/done")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return {int(f.getPath().getName().split("=")[1]) for f in files.listStatus(folder) if "=" in f.getPath().getName()} if files.exists(folder) else set()

    def merge(self, changes: DataFrame, batch: int, order: str | None = None, keep_nulls: bool = False) -> bool:
        """Sets the changes' columns in the rows of their keys, and adds rows for new keys; False if the batch was done before.

        A null is a value like others, unless ``keep_nulls``: then it leaves what is there. A change may name the columns that it
        sets in an array ``named``, and take its row away with ``deleted``. Of several changes of one key the last by ``order``
        counts. Keys are not null."""
        if batch in self.done():
            return False
        special = [c for c in (DELETED, NAMED) if c in changes.columns]
        given = [c for c in self.schema.names if c in changes.columns and c not in self.key]
        new = changes.select(*self.key, *given, *special, *([F.col(order).alias("__order")] if order else []))
        new = last_changes(dealt(new, self.key, new.count()), self.key, "__order").drop("__order") if order else new
        new = new.select(*self.key, F.struct(*given, *special, F.lit(1).alias("one")).alias("__new"), self.bucket()).where(F.col(self.key[0]).isNotNull())
        # as many numbers as there are buckets at most
        touched = sorted(r[BUCKET] for r in new.select(BUCKET).distinct().collect())
        base = self.stored().where(F.col(BUCKET).isin(touched))
        both = base.withColumn("__old", F.lit(True)).join(new, [*self.key, BUCKET], "full_outer")
        hit = F.col("__new").isNotNull()

        def value(c: str) -> Column:
            if c not in given:
                return F.col(c)
            told, sets = F.col(f"__new.{c}"), hit
            if keep_nulls:
                sets = sets & told.isNotNull()
            if NAMED in special:
                sets = sets & (F.col(f"__new.{NAMED}").isNull() | F.array_contains(f"__new.{NAMED}", c))
            return F.when(sets, told).otherwise(F.col(c))

        gone = hit & F.coalesce(F.col(f"__new.{DELETED}"), F.lit(False)) if DELETED in special else F.lit(False)
        merged = both.where(~gone).select(*[F.col(c) if c in self.key else value(c).cast(self.schema[c].dataType).alias(c) for c in self.schema.names], BUCKET)
        self.replace(merged, touched)
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/done/batch={batch}")
        return True

    def replace(self, merged: DataFrame, touched: list[int]) -> None:
        """Replaces buckets by rows with their bucket. Rows are written beside the table and checked first, so the table is not read
        while it changes; a bucket without rows becomes an empty one."""
        staged = f"{self.path}/staged"
        merged.write.mode("overwrite").parquet(staged)
        rows = self.spark.read.schema(merged.schema).parquet(staged)
        # as many numbers as there are buckets at most
        left = {r[BUCKET]: r["count"] for r in rows.groupBy(BUCKET).count().collect()}
        again = dealt(rows.select(*self.key), self.key, sum(left.values())).groupBy(*self.key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
        if again:
            raise ValueError(f"several rows for one key: {again[0].asDict()}")
        if left:
            # a large bucket is several files, so that no task sorts a whole one
            files = -(-max(left.values()) // ROWS_A_TASK)
            spread = rows.repartition(len(left) * files, BUCKET, F.pmod(F.xxhash64(F.lit(files), *self.key), F.lit(files)))
            spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.path}/data")
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for b in set(touched) - set(left):
            folder = hadoop.Path(f"{self.path}/data/{BUCKET}={b}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
