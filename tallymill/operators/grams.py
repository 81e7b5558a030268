"""Substring search that reads only what can hold the term: postings of character trigrams over a table stored in blocks.

A posting tells in which blocks (folders of the table, such as those of ``buckets.Buckets``) some value holds a trigram, in lower
case. A term is looked for in the blocks that all its trigrams share, rarest first, and there it is checked exactly, so the rows are
those of a scan. A list has at most one number for each block, whatever the table's size, and postings lie in folders by a hash of the
trigram, so a search reads the folders of its own trigrams, the blocks that are left, and nothing else.

Postings may tell too much (a value that was changed or taken away leaves its trigrams), never too little, as long as each batch of
new or changed rows is added. A batch has a number and a folder, which is replaced if the batch comes again; ``compact`` brings
folders together. A term of fewer than three characters has no trigram and is looked for in all blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import BUCKET

SIZE = 3
POSTED = "gram string, blocks array<int>, part int, batch long"


def grams_of(value: Column) -> Column:
    """The distinct trigrams of a text in lower case; none for null and for texts under three characters."""
    low = F.lower(value)
    made = F.transform(F.sequence(F.lit(1), F.length(low) - (SIZE - 1)), lambda i: F.substr(low, i, F.lit(SIZE)))
    return F.when(F.length(low) >= SIZE, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


class Grams:
    """Postings under ``path``, in ``parts`` folders by trigram for each batch."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        self.spark, self.path, self.parts = spark, path, parts

    def part(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.parts)).cast("int")

    def posted(self) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], POSTED)
        return self.spark.read.schema(POSTED).parquet(self.path)

    def add(self, rows: DataFrame, values: list[str], batch: int) -> None:
        """Posts the trigrams of these columns of rows with their block. Distinct pairs are found before the shuffle, so a trigram
        that is everywhere costs one row for each block and task."""
        told = F.explode(F.array_distinct(F.flatten(F.array(*[grams_of(F.col(c)) for c in values]))))
        pairs = rows.select(F.col(BUCKET).alias("block"), told.alias("gram")).distinct()
        self.write(pairs.groupBy("gram").agg(F.array_sort(F.collect_list("block")).alias("blocks")), batch)

    def write(self, lists: DataFrame, batch: int) -> None:
        placed = lists.withColumn("part", self.part(F.col("gram"))).withColumn("batch", F.lit(batch).cast("long"))
        sorted_by_gram = placed.repartition(self.parts, "part").sortWithinPartitions("part", "gram")
        sorted_by_gram.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "part").parquet(self.path)

    def compact(self, batch: int) -> None:
        """All postings as those of one batch, the last; the folders of the batches before it go once it is written. If it is lost
        half-way, postings lie in two places, which changes no result, and it can be run again, for it keeps what it has."""
        lists = self.posted().where(F.col("batch") <= batch).groupBy("gram").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("blocks")))).alias("blocks"))
        old = [r["batch"] for r in self.posted().where(F.col("batch") < batch).select("batch").distinct().collect()]
        self.write(lists, batch)
        for b in old:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={b}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def blocks(self, term: str) -> list[int] | None:
        """The blocks that all trigrams of the term share, at most as many numbers as there are blocks; None for a short term."""
        low = term.lower()
        wanted = sorted({low[i : i + SIZE] for i in range(len(low) - SIZE + 1)})
        if not wanted:
            return None
        # hashes of literals are worked out with the plan, so folders are pruned
        own = F.lit(False)
        for g in wanted:
            own = own | (F.col("part") == self.part(F.lit(g)))
        found = self.posted().where(own & F.col("gram").isin(wanted))
        lists = found.groupBy("gram").agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))
        by_rarity = F.array_sort(F.collect_list(F.struct(F.size("blocks").alias("n"), "blocks")))
        shared = F.aggregate(F.slice("lists", 2, len(wanted)), F.col("lists")[0]["blocks"], lambda left, x: F.array_intersect(left, x["blocks"]))
        row = lists.agg(by_rarity.alias("lists")).select(F.when(F.size("lists") == len(wanted), shared).alias("blocks")).first()
        return sorted(row["blocks"] or [])

    def search(self, rows: DataFrame, values: list[str], term: str) -> DataFrame:
        """The rows of which one of these columns contains the term, in any case; the block column prunes folders."""
        needle = F.lit(term.lower())
        holds = F.lit(False)
        for c in values:
            holds = holds | F.coalesce(F.contains(F.lower(F.col(c)), needle), F.lit(False))
        blocks = self.blocks(term)
        return rows.where(holds) if blocks is None else rows.where(F.col(BUCKET).isin(blocks) & holds)
