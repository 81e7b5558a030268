"""A relational table in ranges of its key: disjoint parts, and filters in the database's statement."""

import sqlite3

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from tallymill.plans.roles import table
from tallymill.sources import relational


@pytest.fixture(scope="module")
def database(spark, sf_dir, tmp_path_factory):
    rows = table(spark, sf_dir, "documents_").select("id", "status", "overall_confidence", F.col("review_required").cast("int"), "amount").dropDuplicates(["id"])
    held = [tuple(r) for r in rows.collect()] + [(None, None, None, None, None), (None, "it's", 0.5, 1, 2)]
    path = str(tmp_path_factory.mktemp("db") / "clearing.db")
    with sqlite3.connect(path) as con:
        con.execute('CREATE TABLE "docu""ments" (id INTEGER, status VARCHAR(20) COLLATE NOCASE, overall_confidence REAL, review_required BOOLEAN, amount BIGINT)')
        con.executemany('INSERT INTO "docu""ments" VALUES (?, ?, ?, ?, ?)', held)
        con.execute("CREATE TABLE hollow (id INTEGER, name TEXT)")
    return path, held


def read(spark, database, parts=7):
    return relational.table(spark, database[0], 'docu"ments', "id", parts)


def test_whole_table(spark, database):
    df = read(spark, database)
    assert df.dtypes == [("id", "bigint"), ("status", "string"), ("overall_confidence", "double"), ("review_required", "boolean"), ("amount", "bigint")]
    wanted = [(i, s, c, None if r is None else bool(r), a) for i, s, c, r, a in database[1]]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, wanted))


def test_parts_are_disjoint(spark, database):
    df = read(spark, database).select("id", F.spark_partition_id().alias("part")).where("id is not null")
    bounds = sorted((r["low"], r["high"]) for r in df.groupBy("part").agg(F.min("id").alias("low"), F.max("id").alias("high")).collect())
    assert len(bounds) == 7 and all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))


FILTERS = [
    "status = 'VERIFIED' and amount > 100000", "id in (1, 2, 3, 7)", "overall_confidence <= 0.25 or amount is null", "status is null", "id >= 100 and id < 200 and review_required",
    "status = 'it''s'", "status = 'verified'", "status > 'P' and overall_confidence >= 0.5", "not (status <=> 'VERIFIED')", "id between 5 and 900 and status like '%ED'",
]


@pytest.mark.parametrize("text", FILTERS)
def test_filters_give_the_same_rows(spark, database, text):
    whole = spark.createDataFrame(read(spark, database).collect(), read(spark, database).schema)
    assert sorted(map(str, read(spark, database, 3).where(text).collect())) == sorted(map(str, whole.where(text).collect()))


def test_filters_reach_the_statement():
    reader = relational.Reader({"path": "none", "table": "t", "key": "id"}, None)
    told = [ds.EqualTo(("status",), "VERIFIED"), ds.GreaterThan(("amount",), 5), ds.StringContains(("status",), "x"), ds.In(("id",), (1, 2)), ds.IsNotNull(("status",)), ds.GreaterThan(("status",), "P")]
    assert [type(f) for f in reader.pushFilters(told)] == [ds.StringContains]
    text, values = relational.statement("t", ["id", "status"], "id", 0, 10, False, reader.filters)
    assert text == 'SELECT "id", "status" FROM "t" WHERE ("id" >= ? AND "id" < ?) AND "status" COLLATE BINARY = ? AND "amount" > ? AND "id" IN (?, ?) AND "status" IS NOT NULL AND "status" COLLATE BINARY > ?'
    assert values == [0, 10, "VERIFIED", 5, 1, 2, "P"]


def test_pushed_in_the_plan(spark, database):
    """Spark keeps no filter that the database has taken."""
    df = read(spark, database).where("amount > 100000 and status is not null")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and df.count() == sum(a is not None and a > 100000 and s is not None for _, s, _, _, a in database[1])


def test_empty_and_absent(spark, database):
    assert relational.table(spark, database[0], "hollow", "id").count() == 0
    with pytest.raises(Exception, match="no table"):
        relational.table(spark, database[0], "absent", "id").count()
