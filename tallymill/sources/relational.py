"""A relational table as a Spark source, read in ranges of its key, with columns and comparisons left to the database.

``spark.read.format("relational")`` takes a database file (of SQLite, which Python brings along; other databases are read by
``scans.jdbc_table``), a table and its whole-numbered key. The key's least and largest value are split into ``parts`` ranges, a task
each of equal width, so no two tasks read a row twice; rows without a key are read with the first. Filters that compare a column with a value, ask
for nulls or for one of several values become part of each task's statement, with the values as parameters; any other filter stays
with Spark. A statement is read in batches, so a task holds ``BATCH`` rows at a time.

The file must be readable by all executors. A task that is run again reads its range again.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

BATCH = 10_000
#: Spark's filters and the comparison each is.
COMPARED = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}
#: The types of columns by what their declared type contains, the first that fits.
KINDS = (("INT", "bigint"), ("CHAR", "string"), ("TEXT", "string"), ("CLOB", "string"), ("BLOB", "binary"), ("BOOL", "boolean"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))


def named(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def statement(table: str, columns: list[str], key: str, low: int | None, high: int | None, first: bool, filters: list[tuple[str, list]]) -> tuple[str, list]:
    """The text and parameters of one range's statement."""
    wheres, values = [], []
    if low is not None and high is not None:
        within = f"{named(key)} >= ? AND {named(key)} < ?"
        wheres.append(f"({within} OR {named(key)} IS NULL)" if first else f"({within})")
        values += [low, high]
    for text, told in filters:
        wheres.append(text)
        values += told
    return f"SELECT {', '.join(map(named, columns))} FROM {named(table)}" + (f" WHERE {' AND '.join(wheres)}" if wheres else ""), values


def condition(f: Any) -> tuple[str, list] | None:
    """A filter as SQL with parameters; None if it is left to Spark. Texts compare as bytes, as in Spark, whatever collation a column
    has; values that are no numbers are left to Spark, which orders them."""
    if isinstance(f, ds.Not):
        inner = condition(f.child)
        return None if inner is None or not isinstance(f.child, ds.IsNull | ds.IsNotNull) else (f"NOT ({inner[0]})", inner[1])
    if len(f.attribute) != 1:
        return None
    column = named(f.attribute[0])
    if isinstance(f, ds.IsNull | ds.IsNotNull):
        return f"{column} IS {'NOT ' if isinstance(f, ds.IsNotNull) else ''}NULL", []
    if isinstance(f, ds.In):
        plain = [v for v in f.value if v is not None]
        return (f"{column} IN ({', '.join('?' * len(plain))})", plain) if plain and all(type(v) is int for v in plain) and len(plain) <= 500 else None
    sign = COMPARED.get(type(f))
    if sign is None or type(f.value) not in (int, float, str) or f.value != f.value:
        return None
    return f"{column}{' COLLATE BINARY' if isinstance(f.value, str) else ''} {sign} ?", [f.value]


@dataclass
class Range(ds.InputPartition):
    low: int | None
    high: int | None
    first: bool


class Reader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.table, self.key, self.parts = options["path"], options["table"], options["key"], int(options.get("parts", "32"))
        self.schema, self.filters = schema, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Takes the filters that the database can work out, and gives the others back."""
        for f in filters:
            told = condition(f)
            if told is None:
                yield f
            else:
                self.filters.append(told)

    def partitions(self) -> list[Range]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            low, high = con.execute(f"SELECT min({named(self.key)}), max({named(self.key)}) FROM {named(self.table)}").fetchone()
        if low is None:
            return [Range(None, None, True)]
        parts = max(1, min(self.parts, high - low + 1))
        edges = [low + (high + 1 - low) * i // parts for i in range(parts + 1)]
        return [Range(a, b, i == 0) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]

    def read(self, partition: Range) -> Iterator[tuple]:
        text, values = statement(self.table, self.schema.names, self.key, partition.low, partition.high, partition.first, self.filters)
        flags = [i for i, f in enumerate(self.schema.fields) if f.dataType.typeName() == "boolean"]
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            cursor = con.execute(text, values)
            while rows := cursor.fetchmany(BATCH):
                for row in rows:
                    yield tuple(None if v is None else bool(v) if i in flags else v for i, v in enumerate(row)) if flags else row


class Relational(ds.DataSource):
    """Options ``path``, ``table``, ``key`` and ``parts``."""

    @classmethod
    def name(cls) -> str:
        return "relational"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            told = con.execute(f"PRAGMA table_info({named(self.options['table'])})").fetchall()
        if not told:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{n}` {next((kind for part, kind in KINDS if part in declared.upper()), 'string')}" for _, n, declared, *_ in told)

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options, schema)


def table(spark: SparkSession, path: str, name: str, key: str, parts: int = 32) -> DataFrame:
    """A table of a database file; filters reach it if the session lets Python sources have them, which this sets."""
    spark.dataSource.register(Relational)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("relational").options(path=path, table=name, key=key, parts=str(parts)).load()
