"""Deep pages of a list that is newest first, without sorting what is skipped.

The table lies in ranges of its order (a folder each), with a small table that tells how many rows a range has, by the facets that
pages are filtered by. An offset is located in these counts, and only the ranges that hold the page are read and sorted. A page can
also start behind the last row of the page before it (``after``), which costs the same at any depth and skips or repeats no row if
rows were added meanwhile.

Ranges have about ``per_range`` rows each, or more if there would be over MOST_RANGES of them, by splitters that Spark samples; what reaches
the driver (splitters, counts, one result a range) is bounded so, and a page still sorts a thousandth of the list. Equal timestamps are split by id. Rows without a timestamp come
last, as in a sort; an empty list has empty pages. The counts have a row for each range and combination of facets, so facets are columns of few values.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .prefix import PART, ranges

RANGE = "range"
#: Folders, tasks and rows of counts at most, by combination of facets.
MOST_RANGES = 1024


class Pages:
    """A list stored under ``path``, newest by ``ts`` first, then the largest ``key``; counted by ``facets``."""

    def __init__(self, spark: SparkSession, path: str, ts: str = "created_at", key: str = "id", facets: tuple[str, ...] = ("status", "review_required")):
        self.spark, self.path, self.ts, self.key, self.facets = spark, path, ts, key, facets

    def order(self) -> list[Column]:
        return [F.desc_nulls_last(self.ts), F.desc_nulls_last(self.key)]

    def store(self, rows: DataFrame, per_range: int = 1_000_000) -> None:
        """Writes the list and its counts, in ranges of about ``per_range`` rows, MOST_RANGES at most."""
        parts = min(MOST_RANGES, max(1, -(-rows.count() // per_range)))
        dealt = ranges(rows, self.order(), parts).withColumnRenamed(PART, RANGE)
        # a range is one task's rows already
        dealt.sortWithinPartitions(RANGE, *self.order()).write.mode("overwrite").partitionBy(RANGE).parquet(f"{self.path}/rows")
        dealt.limit(0).write.mode("overwrite").parquet(f"{self.path}/schema")
        first = F.min_by(F.struct(self.ts, self.key), F.struct(F.col(self.ts).isNull(), -F.unix_micros(F.col(self.ts).cast("timestamp")), -F.col(self.key)))
        counts = self.rows().groupBy(RANGE, *self.facets).agg(F.count("*").alias("n"), first.alias("first"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/counts")

    def rows(self) -> DataFrame:
        # an empty list has no file that tells its columns
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/schema").schema).parquet(f"{self.path}/rows")

    def counts(self, wanted: dict[str, Any]) -> list[tuple[int, int]]:
        """(range, rows that the filter leaves), in order; as many as there are ranges."""
        told = self.spark.read.parquet(f"{self.path}/counts").where(self.filter(wanted)).groupBy(RANGE).agg(F.sum("n").alias("n"))
        return sorted((r[RANGE], r["n"]) for r in told.collect())

    def filter(self, wanted: dict[str, Any]) -> Column:
        unknown = set(wanted) - set(self.facets)
        if unknown:
            raise ValueError(f"no counts by {sorted(unknown)}")
        out = F.lit(True)
        for c, v in wanted.items():
            out = out & F.col(c).eqNullSafe(F.lit(v))
        return out

    def read(self, held: list[int], wanted: dict[str, Any]) -> DataFrame:
        return self.rows().where(F.col(RANGE).isin(held)).where(self.filter(wanted)).drop(RANGE)

    def page(self, skip: int = 0, limit: int = 50, **wanted: Any) -> DataFrame:
        """``limit`` rows behind the first ``skip`` ones, of those with these facets; fewer at the end, none behind it."""
        held, before, skipped = [], 0, 0
        for part, n in self.counts(wanted):
            if before + n <= skip:
                skipped += n
            elif before < skip + limit:
                held.append(part)
            before += n
        return self.read(held, wanted).orderBy(*self.order()).offset(skip - skipped if held else 0).limit(limit)

    def total(self, **wanted: Any) -> int:
        return sum(n for _, n in self.counts(wanted))

    def after(self, ts: Any, key: Any, limit: int = 50, **wanted: Any) -> DataFrame:
        """``limit`` rows behind the row with this timestamp (None: of those without) and key."""
        t, k = F.col(self.ts), F.col(self.key)
        same = t.eqNullSafe(F.lit(ts)) & (k < F.lit(key))
        behind = same if ts is None else same | (t < F.lit(ts)) | t.isNull()
        # ranges whose first row lies behind are whole; the one before the first of them may hold the place itself
        told = self.spark.read.parquet(f"{self.path}/counts")
        reach = F.col(f"first.{self.ts}"), F.col(f"first.{self.key}")
        whole = reach[0].eqNullSafe(F.lit(ts)) & (reach[1] < F.lit(key))
        whole = whole if ts is None else whole | (reach[0] < F.lit(ts)) | reach[0].isNull()
        rows = told.groupBy(RANGE).agg(F.bool_and(F.coalesce(whole, F.lit(False))).alias("whole"), F.sum(F.when(self.filter(wanted), F.col("n")).otherwise(0)).alias("n")).collect()
        held, left = [], limit
        parts = sorted((r[RANGE], r["whole"], r["n"]) for r in rows)
        start = max([i for i, (_, w, _) in enumerate(parts) if not w], default=0)
        for part, is_whole, n in parts[start:]:
            if left <= 0:
                break
            if n:
                held.append(part)
                left -= n if is_whole else 0
        return self.read(held, wanted).where(F.coalesce(behind, F.lit(False))).orderBy(*self.order()).limit(limit)
