"""Documents with their children: pivots, nesting, latest run, search and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEDGER = ("cheque_number", "date", "payee_name", "amount", "account_number")


def pivot_fields(fields: DataFrame, names: tuple[str, ...] = LEDGER, aliases: dict[str, str] | None = None) -> DataFrame:
    """One row a document, one column a field: the value of the field's last row. One aggregation, no pass per document."""
    known = F.col("field_name")
    for old, new in (aliases or {}).items():
        known = F.when(F.col("field_name") == old, new).otherwise(known)
    rows = fields.withColumn("__name", known).where(F.col("__name").isin(*names))
    return rows.groupBy("cheque_id").agg(*[F.max_by(F.when(F.col("__name") == n, F.col("normalized_value")), F.when(F.col("__name") == n, F.col("id"))).alias(n) for n in names])


def ledger(documents: DataFrame, fields: DataFrame, limit: int = 500, names: tuple[str, ...] = LEDGER, aliases: dict[str, str] | None = None) -> DataFrame:
    """The newest documents with their fields; the rows are chosen before the join."""
    newest = documents.select("id", "created_at", "status").orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    wanted = fields.join(newest.select(F.col("id").alias("cheque_id")), "cheque_id", "left_semi")
    values = pivot_fields(wanted, names, aliases).withColumnRenamed("cheque_id", "id")
    return newest.join(values, "id", "left").select("id", "created_at", "status", *[F.coalesce(n, F.lit("")).alias(n) for n in names])


def nested(documents: DataFrame, **children: DataFrame) -> DataFrame:
    """Documents with an array of each child table's rows, sorted by id; a document without children has empty arrays."""
    out = documents
    for name, rows in children.items():
        own = ["id", *[c for c in rows.columns if c not in ("id", "cheque_id")]]
        made = rows.groupBy(F.col("cheque_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*own))).alias(name))
        out = out.join(made, "id", "left").withColumn(name, F.coalesce(name, F.array().cast(made.schema[name].dataType)))
    return out


def field_map(fields: DataFrame) -> DataFrame:
    """One map a document: field name to its value and confidence, of the field's last row."""
    last = fields.groupBy("cheque_id", "field_name").agg(F.max_by(F.struct(F.col("normalized_value").alias("value"), "confidence"), "id").alias("v"))
    return last.groupBy("cheque_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", "v")))).alias("fields"))


def latest_run(runs: DataFrame, ts: str = "run_timestamp") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("cheque_id").orderBy(F.desc(ts), F.desc("id")))
    return runs.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def earliest_run(runs: DataFrame) -> DataFrame:
    return runs.groupBy("cheque_id").agg(F.min("id").alias("run_id"))


def with_run_id(rows: DataFrame, runs: DataFrame, otherwise: int = 1) -> DataFrame:
    return rows.join(earliest_run(runs), "cheque_id", "left").withColumn("run_id", F.coalesce("run_id", F.lit(otherwise)))


def search(documents: DataFrame, fields: DataFrame, term: str, identifier: str = "cheque_identifier", field_term: str | None = None) -> DataFrame:
    """Documents whose identifier or any field value contains the term, in any case; values may be held against a term of their own."""
    holds = lambda column, t: F.contains(F.lower(column), F.lit(t.lower()))
    hits = fields.where(holds("normalized_value", term if field_term is None else field_term)).select(F.col("cheque_id").alias("id")).distinct().withColumn("__hit", F.lit(True))
    return documents.join(hits, "id", "left").where(holds(identifier, term) | F.col("__hit")).drop("__hit")


def page(documents: DataFrame, skip: int = 0, limit: int = 50, status: str | None = None, review_required: bool | None = None, ts: str = "created_at") -> DataFrame:
    if status is not None:
        documents = documents.where(F.col("status") == status)
    if review_required is not None:
        documents = documents.where(F.col("review_required") == review_required)
    return documents.orderBy(F.desc(ts), F.desc("id")).offset(skip).limit(limit)


def history(documents: DataFrame, fields: DataFrame, runs: DataFrame, names: tuple[str, ...], amount: Column) -> DataFrame:
    """A line of the history for each document: fields, formatted amount, yes or no, latest latency."""
    values = pivot_fields(fields, names).withColumnRenamed("cheque_id", "id")
    last = latest_run(runs).select(F.col("cheque_id").alias("id"), F.round("total_latency_ms", 1).alias("latency"))
    made = documents.select("id", "status", "review_required", amount.alias("__amount")).join(values, "id", "left").join(last, "id", "left")
    return made.select("id", "status", F.when(F.col("review_required"), "YES").otherwise("NO").alias("review"), *[F.coalesce(n, F.lit("-")).alias(n) for n in names if n != "amount"], F.coalesce(F.format_number("__amount", 2), F.lit("-")).alias("amount"), F.coalesce("latency", F.lit(0.0)).alias("latency"))


def lookup(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The rows with this key; the comparison reaches the scan. Null finds none."""
    return rows.where(F.col(key) == F.lit(value))


def fields_by_name(fields: DataFrame) -> DataFrame:
    """For each document its fields' names in order, a name as often as it has rows, then by id."""
    named = F.array_sort(F.collect_list(F.struct("field_name", "id")))
    return fields.groupBy("cheque_id").agg(named.alias("named")).select("cheque_id", F.col("named.field_name").alias("names"), F.col("named.id").alias("ids"))
