"""Tables whose files are chosen before they are read: a zone and a filter of keys for each file.

``store`` writes a table in ranges of its key, one file or a few a range, with Parquet's own Bloom filters, and beside it two small
tables: zones (least and largest key, rows, whether there are null keys, by file) and a filter of each file's keys. The filter is a
Bloom filter of two hashes over 16 bits a key, made by the bitmap aggregates, in maps of 32,768 bits: about 14 in 1,000 absent
keys pass one. So a look-up of a present key reads its file, of an absent one mostly none, and a batch of keys meets zones and maps
in joins on equal values that say which files matter, before any of these is opened.

Values are those of a scan: zones and filters only leave out files that cannot hold a key. Rows with a null key are found by no
look-up, as in a comparison.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.prefix import PART, carried, joined, ranges

#: Bits of a map of the bitmap aggregates (fixed by them), bits for each key, and seeds of the hashes.
MAP_BITS, KEY_BITS, SEEDS = 32768, 16, (11, 23)
FILE = "file"


def _file() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def _bits(key: str, bits: Column) -> Column:
    """The places of a key's bits among so many, by file."""
    return F.array(*[F.pmod(F.xxhash64(F.col(key), F.lit(s)), bits) for s in SEEDS])


class Skipping:
    """A table under ``path`` that is looked up by ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key

    def store(self, rows: DataFrame, per_file: int = 4_000_000) -> None:
        """Writes the table and what is told of its files, ``per_file`` rows in one at most."""
        n = rows.count()
        writer = rows.repartitionByRange(max(1, -(-n // per_file)), F.col(self.key)).sortWithinPartitions(self.key).write.mode("overwrite")
        writer = writer.option("maxRecordsPerFile", per_file).option(f"parquet.bloom.filter.enabled#{self.key}", "true").option(f"parquet.bloom.filter.expected.ndv#{self.key}", min(n, per_file) or 1)
        writer.parquet(f"{self.path}/rows")
        held = self.spark.read.parquet(f"{self.path}/rows").select(_file().alias(FILE), F.col(self.key))
        zones = held.groupBy(FILE).agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"), F.count("*").alias("n"), F.count_if(F.col(self.key).isNull()).alias("nulls"))
        bits = (F.ceil(F.col("n") * KEY_BITS / MAP_BITS) * MAP_BITS).cast("long")
        zones.withColumn("bits", bits).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/zones")
        # as many zones as files: Spark sends them to the tasks if they are small, and joins by file if not
        placed = held.where(F.col(self.key).isNotNull()).join(self.zones().select(FILE, "bits"), FILE).select(FILE, F.explode(_bits(self.key, F.col("bits"))).alias("at"))
        maps = placed.groupBy(FILE, F.floor(F.col("at") / MAP_BITS).cast("int").alias("map")).agg(F.bitmap_construct_agg(F.col("at") % MAP_BITS).alias("held"))
        maps.write.mode("overwrite").parquet(f"{self.path}/maps")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def zones(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/zones")

    def maps(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/maps")

    def candidates(self, keys: DataFrame) -> DataFrame:
        """(key, file): the files that may hold each distinct key of a table. Files follow the key's order, so a key lies in the last
        one that starts at or before it, or in one that ends or starts with it; what these leave meets the maps by file and map."""
        wanted = keys.select(F.col(self.key)).where(F.col(self.key).isNotNull()).distinct()
        zones = self.zones().where(F.col("low").isNotNull())
        edges = zones.select(F.explode(F.array_distinct(F.array("low", "high"))).alias(self.key), FILE).join(wanted, self.key, "left_semi")
        return self.passed(self.last_start(wanted, zones).union(edges).distinct())

    def last_start(self, wanted: DataFrame, zones: DataFrame) -> DataFrame:
        """(key, file): the last file that starts at or before each key, if one does, by one pass over ranges of keys and starts."""
        starts = zones.select(F.col("low").alias(self.key), FILE, F.lit(0).alias("asks"))
        order = [F.col(self.key), F.col("asks"), F.col(FILE)]
        dealt = ranges(starts.unionByName(wanted.select(self.key, F.lit(None).cast("string").alias(FILE), F.lit(1).alias("asks"))), order)
        own = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        lasts = dealt.groupBy(PART).agg(F.max_by(FILE, F.when(F.col("asks") == 0, F.struct(self.key, FILE))).alias("last"))
        before = carried(lasts, (), {"before": F.last("last", ignorenulls=True)})
        met = joined(dealt.withColumn("at", F.last(FILE, ignorenulls=True).over(own)), before, ())
        return met.where("asks = 1").select(self.key, F.coalesce("at", "before").alias(FILE)).where(F.col(FILE).isNotNull())

    def passed(self, met: DataFrame) -> DataFrame:
        """Of pairs of a key and a file those that zone and filter let pass."""
        inside = met.join(self.zones(), FILE).where(F.col(self.key).between(F.col("low"), F.col("high")))
        asked = inside.select(self.key, FILE, F.explode(_bits(self.key, F.col("bits"))).alias("at")).withColumn("map", F.floor(F.col("at") / MAP_BITS).cast("int"))
        byte = F.conv(F.hex(F.substr("held", F.floor(F.col("at") % MAP_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
        hit = asked.join(self.maps(), [FILE, "map"]).where(F.getbit(byte, (F.col("at") % 8).cast("int")) == 1)
        # hashes of a key may meet in one bit, which then is told as often
        return hit.groupBy(self.key, FILE).agg(F.count("*").alias("bits")).where(F.col("bits") == len(SEEDS)).select(self.key, FILE)

    def read(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.rows().schema)
        return self.spark.read.schema(self.rows().schema).parquet(*[f"{self.path}/rows/{f}" for f in files])

    def lookup(self, value: Any) -> DataFrame:
        """The rows with this key, from the files that may hold it."""
        v = F.lit(value).cast(self.rows().schema[self.key].dataType)
        met = self.zones().where(v.between(F.col("low"), F.col("high"))).select(v.alias(self.key), FILE)
        return self.read(sorted(r[FILE] for r in self.passed(met).select(FILE).distinct().collect())).where(F.col(self.key) == v)

    def files(self, keys: DataFrame) -> list[str]:
        """Names of the files that may hold one of the keys; at most as many as the table has."""
        return sorted(r[FILE] for r in self.candidates(keys).select(FILE).distinct().collect())

    def told(self, batch: DataFrame, name: str = "known") -> DataFrame:
        """All rows of a batch with whether the table holds their key (null keys: no), by one choice of files and one join."""
        kept = self.read(self.files(batch)).select(self.key).distinct().withColumn(name, F.lit(True))
        return batch.join(kept, self.key, "left").withColumn(name, F.coalesce(name, F.lit(False)))

    def known(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose key the table holds."""
        return batch.join(self.read(self.files(batch)).select(self.key), self.key, "left_semi")

    def new(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose key the table does not hold, null keys among them."""
        return batch.join(self.read(self.files(batch)).select(self.key), self.key, "left_anti")
