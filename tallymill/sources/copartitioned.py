"""Tables that lie together: a parent and its children in the same number of buckets by the document's id, each bucket sorted by it.

Joins, groupings and pivots by that id read bucket by bucket, with no shuffle and no sort, however large the tables are. The
buckets are of the catalog's tables, so a session that did not write them names their folder and schema once (``attach``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save(df: DataFrame, name: str, key: str, buckets: int = 64, path: str | None = None) -> DataFrame:
    """Writes a table in ``buckets`` buckets of ``key`` and gives it as read from there. Rows are dealt to the buckets first, so
    a bucket is one file."""
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def attach(spark: SparkSession, name: str, schema: str, key: str, path: str, buckets: int = 64) -> DataFrame:
    """A table that another session wrote to ``path``."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
