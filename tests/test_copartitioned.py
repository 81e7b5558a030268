"""Children of documents over tables in buckets: no shuffle, same rows."""

import pytest
from pyspark.sql import functions as F

from tallymill.operators import ledger
from tallymill.plans.roles import table
from tallymill.sources import copartitioned


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    plain = {n: table(spark, sf_dir, f"{n}_") for n in ("documents", "fields", "checks")}
    kept = {n: copartitioned.save(df, f"co_{n}", "id" if n == "documents" else "cheque_id", 8) for n, df in plain.items()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the tables are small here
    yield plain, kept
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for n in plain:
        spark.sql(f"DROP TABLE IF EXISTS co_{n}")


QUERIES = {
    "nested": lambda t: ledger.nested(t["documents"], fields=t["fields"], checks=t["checks"]),
    "pivot": lambda t: ledger.pivot_fields(t["fields"]),
    "pivot_joined": lambda t: t["documents"].join(ledger.pivot_fields(t["fields"]).withColumnRenamed("cheque_id", "id"), "id"),
    "valid": lambda t: t["documents"].join(t["checks"].where("is_valid").withColumnRenamed("id", "check_id").withColumnRenamed("cheque_id", "id"), "id").groupBy("id").agg(F.count("*").alias("n")),
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_shuffle(tables, name):
    plain, kept = tables
    df = QUERIES[name](kept)
    got = sorted(map(str, df.collect()))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert got == sorted(map(str, QUERIES[name](plain).collect()))


def test_attached(spark, tables, tmp_path):
    plain, _ = tables
    path = str(tmp_path / "fields")
    copartitioned.save(plain["fields"], "co_written", "cheque_id", 4, path)
    spark.sql("DROP TABLE co_written")
    again = copartitioned.attach(spark, "co_again", plain["fields"]._jdf.schema().toDDL(), "cheque_id", path, 4)
    df = ledger.pivot_fields(again)
    assert df.count() == ledger.pivot_fields(plain["fields"]).count()
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE co_again")
