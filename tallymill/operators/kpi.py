"""Key figures of the clearing tables: one pass each, only aggregates leave the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import amount_of, is_plain_number, percent
from .quantiles import between, interpolated, nearest, with_order_statistics

#: Edges of the confidence histogram.
EDGES = (0.50, 0.70, 0.85, 0.95)


def within(df: DataFrame, ts: str, start: object = None, end: object = None) -> DataFrame:
    """Rows of an inclusive time window; a bound that is not given is not applied, so the raw column reaches the scan."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end))
    return df


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def by_status(df: DataFrame, status: str = "status") -> DataFrame:
    """Count and share of each status; the share is taken over the few aggregated rows."""
    counted = df.groupBy(status).agg(F.count("*").alias("n"))
    return counted.withColumn("share", percent(F.col("n"), F.sum("n").over(Window.partitionBy()))).orderBy(F.desc("n"), status)


def _review_figures(flag: str = "review_required", confidence: str = "overall_confidence") -> dict[str, Column]:
    n, flagged = F.count("*"), F.count_if(F.col(flag))
    mean = F.round(F.coalesce(F.avg(confidence), F.lit(0.0)), 4)
    return {"total": n, "flagged": flagged, "auto_cleared": n - flagged, "review_rate": percent(flagged, n), "mean_confidence": mean}


def review_stats(df: DataFrame, flag: str = "review_required", confidence: str = "overall_confidence") -> DataFrame:
    return df.agg(*[c.alias(k) for k, c in _review_figures(flag, confidence).items()])


def _volume_figures(status: str = "status") -> dict[str, Column]:
    count = lambda s: F.count_if(F.col(status) == s)
    return {"total": F.count("*"), **{s.lower(): count(s) for s in ("VERIFIED", "REVIEW_REQUIRED", "INVALID", "PROCESSED")}}


def volume(df: DataFrame, status: str = "status") -> DataFrame:
    return df.agg(*[c.alias(k) for k, c in _volume_figures(status).items()])


def _zero(c: Column) -> Column:
    return F.round(F.coalesce(c, F.lit(0.0)), 2)


def _amount_figures(x: Column) -> dict[str, Column]:
    of = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_pop}
    return {"n": F.count(x), **{k: _zero(f(x)) for k, f in of.items()}}


def _median(column: str) -> Column:
    """Of a column whose ranks are those of between(0.5)."""
    return interpolated(0.5, F.col(f"n_{column}"), F.col(f"{column}_0"), F.col(f"{column}_1"))


def amount_stats(df: DataFrame, text: str) -> DataFrame:
    """Of amounts as text, cleaned; what cannot be read is left out."""
    x = F.col("__x")
    made = with_order_statistics(df.select(amount_of(F.col(text)).alias("__x")), {"x": x}, {"x": between(0.5)}, _amount_figures(x))
    return made.select("n", "sum", "mean", _zero(_median("x")).alias("median"), "min", "max", "std")


def amount_stats_strict(df: DataFrame, text: str) -> DataFrame:
    """Only texts that are plain numbers."""
    x = F.col(text).try_cast("double")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 2)
    return df.where(is_plain_number(F.col(text))).agg(F.count("*").alias("n"), zero(F.sum(x)).alias("sum"), zero(F.avg(x)).alias("mean"), zero(F.min(x)).alias("min"), zero(F.max(x)).alias("max"))


def _histogram_figures(x: Column, edges: tuple[float, ...]) -> dict[str, Column]:
    bounds = [float("-inf"), *edges, float("inf")]
    buckets = {f"bucket_{i}": F.count_if((x >= lo) & (x < hi)) for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:]))}
    return {"n": F.count(x), "mean": F.round(F.avg(x), 4), "std": F.round(F.stddev_pop(x), 4), **buckets}


def confidence_histogram(df: DataFrame, confidence: str, edges: tuple[float, ...] = EDGES) -> DataFrame:
    """Counts between fixed edges (a bucket without rows is 0), median and population deviation."""
    made = with_order_statistics(df, {"x": F.col(confidence)}, {"x": between(0.5)}, _histogram_figures(F.col(confidence), edges))
    return made.select("n", "mean", F.round(_median("x"), 4).alias("median"), "std", *[f"bucket_{i}" for i in range(len(edges) + 1)])


def field_performance(fields: DataFrame) -> DataFrame:
    tier = lambda t: F.count_if(F.col("confidence_tier") == t).alias(t.lower())
    method = lambda m: F.count_if(F.col("extraction_method") == m).alias(f"by_{m}")
    means = [F.round(F.avg(c), 4).alias(f"avg_{c}") for c in ("confidence", "detection_confidence", "extraction_confidence")]
    return fields.groupBy("field_name").agg(F.count("*").alias("n"), *means, tier("HIGH"), tier("MEDIUM"), tier("LOW"), method("ocr"), method("recognizer"), method("hybrid")).orderBy(F.desc("n"), "field_name")


def validation_overall(checks: DataFrame) -> DataFrame:
    valid = F.count_if(F.col("is_valid"))
    return checks.agg(F.count("*").alias("total"), valid.alias("valid"), (F.count("*") - valid).alias("invalid"), percent(valid, F.count("*")).alias("pass_rate"))


def validation_by_type(checks: DataFrame) -> DataFrame:
    valid = F.count_if(F.col("is_valid"))
    return checks.groupBy("check_type").agg(F.count("*").alias("total"), valid.alias("valid"), (F.count("*") - valid).alias("invalid"), percent(valid, F.count("*")).alias("pass_rate")).orderBy(F.desc("total"), "check_type")


def top_reasons(checks: DataFrame, n: int = 10) -> DataFrame:
    flagged = checks.where(F.col("validation_status").isin("INVALID", "WARNING"))
    return flagged.groupBy("validation_reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "validation_reason").limit(n)


def latency_stats(runs: DataFrame, latency: str = "total_latency_ms") -> DataFrame:
    x, shares = F.col(latency), (0.5, 0.9, 0.99)
    figures = {"n": F.count(x), **{k: F.round(f(x), 2) for k, f in {"mean": F.avg, "min": F.min, "max": F.max}.items()}}
    made = with_order_statistics(runs, {"x": x}, {"x": [r for p in shares for r in nearest(p)]}, figures)
    return made.select("n", "mean", "min", "max", *[F.round(f"x_{i}", 2).alias(f"p{round(100 * p)}") for i, p in enumerate(shares)])


def _percentiles(shares: tuple[float, ...]) -> list[Column]:
    """Of a column x whose ranks are those of between for each share, in turn."""
    return [interpolated(p, F.col("n_x"), F.col(f"x_{2 * i}"), F.col(f"x_{2 * i + 1}")) for i, p in enumerate(shares)]


def latency_interpolated(runs: DataFrame, latency: str = "total_latency_ms", approximate: bool = False) -> DataFrame:
    """Percentiles between ranks, exact, or with ``approximate`` from a sketch in one pass."""
    shares = (0.5, 0.9, 0.95, 0.99)
    if approximate:
        return runs.agg(*[F.round(F.percentile_approx(latency, p, 10_000), 2).alias(f"p{round(100 * p)}") for p in shares])
    made = with_order_statistics(runs, {"x": F.col(latency)}, {"x": [r for p in shares for r in between(p)]})
    return made.select(*[F.round(v, 2).alias(f"p{round(100 * p)}") for p, v in zip(shares, _percentiles(shares))])


def stage_latency(runs: DataFrame, stages: dict[str, Column], latency: str = "total_latency_ms", failed: Column | None = None) -> DataFrame:
    """Mean, median and interpolated p95 of the whole, means of the stages, rate of failures."""
    x, shares = F.col(latency), (0.5, 0.95)
    rate = percent(F.count_if(failed), F.count("*")) if failed is not None else F.max(F.lit(0.0))
    figures = {"mean": F.round(F.avg(x), 2), **{f"mean_{k}": F.round(F.avg(c), 2) for k, c in stages.items()}, "failure_rate": rate}
    made = with_order_statistics(runs, {"x": x}, {"x": [r for p in shares for r in between(p)]}, figures)
    median, p95 = _percentiles(shares)
    return made.select("mean", F.round(median, 2).alias("median"), F.round(p95, 2).alias("p95"), *[f"mean_{k}" for k in stages], "failure_rate")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def most_common(df: DataFrame, column: str, ordinal: str, n: int = 8) -> DataFrame:
    """The most frequent values; ties by first appearance."""
    return df.groupBy(column).agg(F.count("*").alias("n"), F.min(ordinal).alias("first")).orderBy(F.desc("n"), "first").limit(n).select(column, "n")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of both columns with margins; a margin's column is 'All'."""
    level = F.grouping_id()
    made = df.cube(a, b).agg(F.count("*").alias("n"), level.alias("level"))
    name = lambda c, bit: F.when(F.col("level").bitwiseAND(bit) > 0, "All").otherwise(F.col(c))
    return made.select(name(a, 2).alias(a), name(b, 1).alias(b), "n")


def sla(runs: DataFrame, documents: DataFrame, target_latency: float = 250.0, target_review: float = 15.0, latency: str = "total_latency_ms") -> DataFrame:
    """Two one-row aggregates side by side, held against their targets."""
    made = latency_stats(runs, latency).select("p90").join(review_stats(documents).select("review_rate"))
    ok_p90, ok_review = F.col("p90") <= target_latency, F.col("review_rate") <= target_review
    return made.select("p90", ok_p90.alias("latency_met"), "review_rate", ok_review.alias("review_met"), F.round(100 - F.col("review_rate"), 2).alias("auto_cleared_rate"), (ok_p90 & ok_review).alias("met"))


def document_figures(documents: DataFrame, amounts: DataFrame, amount: str, with_confidence: bool = False) -> DataFrame:
    """One row of volumes, reviews, amounts and, if asked for, confidences with their medians. If the amounts are a column of the
    documents, all of it takes the same two scans."""
    x, confidence = F.col("__amount"), F.col("overall_confidence")
    figures = {f"volume_{k}": c for k, c in _volume_figures().items()} | {f"review_{k}": c for k, c in _review_figures().items()}
    if with_confidence:
        figures |= {f"confidence_{k}": c for k, c in _histogram_figures(confidence, EDGES).items()}
    columns, ranks = {"confidence": confidence} if with_confidence else {}, {"confidence": between(0.5)}
    if amounts is documents:
        rows = documents.withColumn("__amount", amount_of(F.col(amount)))
        return with_order_statistics(rows, {"amount": x, **columns}, {"amount": between(0.5), **ranks}, figures | {f"amount_{k}": c for k, c in _amount_figures(x).items()})
    told = amounts.select(amount_of(F.col(amount)).alias("__amount"))
    of_amounts = with_order_statistics(told, {"amount": x}, {"amount": between(0.5)}, {f"amount_{k}": c for k, c in _amount_figures(x).items()})
    return (with_order_statistics(documents, columns, ranks, figures) if columns else documents.agg(*[c.alias(k) for k, c in figures.items()])).join(of_amounts)


def _headline(figures: DataFrame) -> list[Column]:
    c = F.col
    volumes = [c(f"volume_{k}") for k in ("total", "verified", "review_required", "invalid")]
    reviews = [c("review_flagged").alias("flagged"), c("review_review_rate").alias("review_rate"), c("review_mean_confidence").alias("mean_confidence")]
    amounts = [c("amount_n").alias("amounts"), c("amount_sum"), _zero(_median("amount")).alias("amount_median")]
    return [*volumes, *reviews, F.round(100 - c("review_review_rate"), 1).alias("straight_through_rate"), *amounts]


def _with_checks_and_runs(headline: DataFrame, checks: DataFrame, runs: DataFrame) -> DataFrame:
    return headline.join(validation_overall(checks).select(F.col("total").alias("checks"), "pass_rate")).join(latency_stats(runs).select("p50", "p90", "p99"))


def executive_summary(documents: DataFrame, amounts: DataFrame, checks: DataFrame, runs: DataFrame, amount: str = "normalized_value") -> DataFrame:
    """Headline figures as one row: two scans of the documents and of the runs, one of the checks."""
    figures = document_figures(documents, amounts, amount)
    return _with_checks_and_runs(figures.select(*_headline(figures)), checks, runs)


def dated(children: DataFrame, documents: DataFrame, start: object = None, end: object = None, ts: str = "created_at") -> DataFrame:
    """Children of documents within a time window; without a bound the documents are not even read."""
    if start is None and end is None:
        return children
    return children.join(within(documents, ts, start, end).select(F.col("id").alias("cheque_id")), "cheque_id", "left_semi")


#: What the figures are called in each record of the dashboard.
RECORDS = {
    "amounts": {"n": "cheques_with_amount_count", "sum": "total_recognized_amount", "mean": "average_amount", "median": "median_amount", "min": "min_amount", "max": "max_amount", "std": "std_amount"},
    "reviews": {"total": "total_cheques", "flagged": "review_required_count", "auto_cleared": "auto_cleared_count", "review_rate": "manual_review_rate_pct", "mean_confidence": "average_confidence"},
    "confidence": {"n": "total_evaluated", "mean": "mean_confidence", "median": "median_confidence", "std": "std_confidence"},
    "validation": {"total": "total_checks", "valid": "valid_count", "invalid": "invalid_count", "pass_rate": "pass_rate_pct"},
    "fields": {"n": "total_extractions", "high": "high_tier_count", "medium": "medium_tier_count", "low": "low_tier_count", "by_ocr": "ocr_method_count", "by_recognizer": "recognizer_method_count"},
    "latency": {"n": "total_runs", "mean": "avg_latency_ms", "min": "min_latency_ms", "max": "max_latency_ms", "p50": "p50_latency_ms", "p90": "p90_latency_ms", "p99": "p99_latency_ms"},
}


def record(name: str, figures: DataFrame) -> DataFrame:
    """Key figures under the names of the dashboard's record."""
    return figures.withColumnsRenamed(RECORDS[name])


def measures(**records: DataFrame) -> DataFrame:
    """(record, measure, value) of one-row records."""
    parts = []
    for name, row in records.items():
        numbers = [F.col(c).cast("double").alias(c) for c in row.columns]
        parts.append(row.select(*numbers).unpivot([], row.columns, "measure", "value").select(F.lit(name).alias("record"), "measure", "value"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def rates(rows: DataFrame, column: str, everything: DataFrame) -> DataFrame:
    """Frequencies of a column's values, and their rate over all rows of another table."""
    total = everything.agg(F.count("*").alias("total"))
    return rows.groupBy(column).agg(F.count("*").alias("n")).join(total).select(column, "n", percent(F.col("n"), F.col("total")).alias("rate"))


def executive_record(documents: DataFrame, amounts: DataFrame, fields: DataFrame, checks: DataFrame, runs: DataFrame, amount: str = "normalized_value") -> DataFrame:
    """One row with every facet: headline figures, status counts, confidence buckets, validation by type, top reasons and field
    performance. Facets with several rows are arrays of structs in a fixed order; they have a row a status, type or field."""
    def gathered(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))

    figures = document_figures(documents, amounts, amount, with_confidence=True)
    buckets = F.array(*[F.col(f"confidence_bucket_{i}") for i in range(len(EDGES) + 1)]).alias("confidence_buckets")
    told = figures.select(*_headline(figures), *[f"amount_{k}" for k in ("mean", "min", "max", "std")], buckets, F.round(_median("confidence"), 4).alias("confidence_median"))
    parts = [
        _with_checks_and_runs(told, checks, runs),
        gathered(by_status(documents), "statuses"),
        gathered(validation_by_type(checks), "checks_by_type"),
        gathered(top_reasons(checks).select("n", "validation_reason"), "top_reasons"),
        gathered(field_performance(fields), "fields"),
    ]
    return reduce(lambda a, b: a.join(b), parts)
