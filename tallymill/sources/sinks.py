"""Writers: every one is distributed; only rendered reports of a few rows pass the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.datasets import flattened


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def flat_csv(df: DataFrame, path: str) -> None:
    """CSV with header; nested columns as text."""
    flattened(df).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def by_split(df: DataFrame, path: str, column: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(column).json(path)


def append(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def field_report(performance: DataFrame) -> DataFrame:
    """Field performance with confidences as text of four digits."""
    return performance.select(*[F.format_string("%.4f", c).alias(c) if c.startswith("avg_") else F.col(c) for c in performance.columns])


def coco_folder(sections: dict[str, DataFrame], path: str) -> None:
    """The sections of an export as JSON lines, images and annotations in a folder a split."""
    for name, rows in sections.items():
        writer = rows.write.mode("overwrite")
        (writer.partitionBy("split") if "split" in rows.columns else writer).json(f"{path}/{name}")


#: The targets that a report holds its figures against, and whether a figure has to be below them.
TARGETS = {"review_rate": (15.0, True), "mean_confidence": (0.85, False), "pass_rate": (90.0, False), "p50": (200.0, True), "p99": (500.0, True)}


def executive_markdown(record: DataFrame, generated: str, period: str = "All Time to Present") -> str:
    """The report of an executive record (kpi.executive_record, one row) in seven sections: headline figures with their targets,
    statuses, amounts, confidences, fields, checks with the top reasons, and the notice. Its lists are as long as there are statuses,
    fields and top reasons."""
    r = record.first().asDict(recursive=True)
    share = lambda n, of: 100 * n / of if of else 0.0

    def line(title: str, value: str, key: str | None = None) -> str:
        if key is None:
            return f"| {title} | {value} | |"
        target, below = TARGETS[key]
        met = r[key] is not None and (r[key] < target if below else r[key] > target)
        return f"| {title} | {value} | {'<' if below else '>'} {target:g}: {'met' if met else 'missed'} |"

    number = lambda v, form: "none" if v is None else format(v, form)
    out = ["# Clearing report", f"Generated {generated}, period {period}", "", "## 1. Headline figures", "", "| Figure | Value | Target |", "|---|---|---|"]
    out += [
        line("Documents", f"{r['volume_total']:,}"), line("Verified", f"{r['volume_verified']:,}"), line("For review", f"{r['flagged']:,} ({number(r['review_rate'], '.1f')} %)", "review_rate"),
        line("Recognised amount", number(r["amount_sum"], ",.2f")), line("Mean amount", number(r["amount_mean"], ",.2f")), line("Mean confidence", number(r["mean_confidence"], ".4f"), "mean_confidence"),
        line("Checks passed", f"{number(r['pass_rate'], '.1f')} %", "pass_rate"), line("Median latency", f"{number(r['p50'], '.1f')} ms", "p50"), line("Latency at 99 %", f"{number(r['p99'], '.1f')} ms", "p99"), "",
    ]
    out += ["## 2. Statuses", "", *[f"- {s['status']}: {s['n']:,} ({share(s['n'], r['volume_total']):.1f} %)" for s in sorted(r["statuses"], key=lambda s: (-s["n"], s["status"] or ""))], ""]
    out += ["## 3. Amounts", "", *[f"- {title}: {number(r[key], ',.2f')}" for title, key in (("Sum", "amount_sum"), ("Mean", "amount_mean"), ("Median", "amount_median"), ("Least", "amount_min"), ("Largest", "amount_max"), ("Deviation", "amount_std"))], ""]
    edges = ["below 0.50", "0.50 to 0.70", "0.70 to 0.85", "0.85 to 0.95", "0.95 and above"]
    counted = sum(r["confidence_buckets"])
    out += ["## 4. Confidences", "", "| Range | Documents | Share |", "|---|---|---|", *[f"| {e} | {n:,} | {share(n, counted):.1f} % |" for e, n in zip(edges, r["confidence_buckets"])], ""]
    out += ["## 5. Fields", "", "| Field | Extractions | Mean confidence | High | Medium | Low | Method |", "|---|---|---|---|---|---|---|"]
    out += [f"| {f['field_name']} | {f['n']:,} | {number(f['avg_confidence'], '.4f')} | {f['high']:,} | {f['medium']:,} | {f['low']:,} | {'OCR' if f['by_ocr'] >= f['by_recognizer'] else 'recogniser'} |" for f in sorted(r["fields"], key=lambda f: (-f["n"], f["field_name"] or ""))]
    valid, total = sum(c["valid"] for c in r["checks_by_type"]), sum(c["total"] for c in r["checks_by_type"])
    out += ["", "## 6. Checks", "", f"- In all: {total:,}", f"- Passed: {valid:,}", f"- Failed: {total - valid:,}", ""]
    out += [f"{i}. {x['validation_reason']} ({x['n']:,})" for i, x in enumerate(sorted(r["top_reasons"], key=lambda x: (-x["n"], x["validation_reason"] or "")), 1)]
    out += ["", "## 7. Notice", "", "> Outliers are signals for a review by people, and never a claim of fraud."]
    return "\n".join(out)


def metrics_json(metrics: DataFrame, cases: DataFrame, path: str, limit: int = 60) -> None:
    """One JSON object: the figures (a row) and the first error cases in order."""
    from ..operators.evaluate import first_errors

    listed = first_errors(cases, limit=limit).agg(F.sort_array(F.collect_list(F.struct("ordinal", *[c for c in cases.columns if c != "ordinal"]))).alias("error_cases"))
    metrics.join(listed).coalesce(1).write.mode("overwrite").json(path)
