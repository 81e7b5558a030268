"""What the operators share: Arrow batches in parts, and tables that cut the lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that a task turns into Python objects at once; their texts may be long.
ROWS_AT_ONCE = 256
#: Parts in which the rows of one key look something up.
PARTS = 64


_HELD: dict[object, object] = {}


def remembered(name: object, make: Callable[[], object]) -> object:
    """What a worker keeps between tasks of one operator, made when first asked for. Workers live on from stage to stage, so what
    another operator kept there is let go first: a worker's memory is that of one operator, however many stages it served."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def map_parts(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType, rows: int = ROWS_AT_ONCE) -> DataFrame:
    """mapInArrow with bounded parts: ``make`` runs once in each task and gives what is applied to each part."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield apply(b.slice(at, rows))

    return df.mapInArrow(task, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's own, else, on one machine only (as in tests), one made here."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tallymill-")
        sc.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it again: computed once, and lost executors cost nothing later."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def look_up(rows: DataFrame, key: str, by: str, table: DataFrame) -> DataFrame:
    """Rows with what ``table`` (one row a key) tells of their key, null where it tells nothing. A key may have very many rows,
    so they meet its entry in parts, dealt by the column ``by``."""
    part = free_name("part", rows, table)
    rows = rows.withColumn(part, F.pmod(F.xxhash64(by), F.lit(PARTS)))
    told = rows.select(key, part).distinct().join(table, key)
    return rows.join(told, [key, part], "left").drop(part)


def free_name(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def first_hashes(rows: DataFrame, h: str, n: int, total: int) -> DataFrame:
    """Rows whose uniform 64-bit hash is low enough that about twice ``n`` of ``total`` remain, so that taking the first ``n`` of
    them sends no more than that to the driver; all of them if there are no more."""
    if total <= 2 * n:
        return rows
    return rows.where(F.col(h) < -(1 << 63) + int((1 << 64) * (2 * n / total)))
