"""Exact order statistics against sorted lists, and numbering in parts against plain numbering."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tallymill.operators import datasets, evaluate, kpi, prefix, quantiles


def scans(df) -> int:
    """The scans of the plan as it ran: what is reused runs once, and a subquery's first plan reads the same columns as its last."""
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]
    return len(set(re.findall(r"FileScan parquet \[([^\]]*)\]", ran)))


@pytest.mark.parametrize("sketch", [4096, 64])
def test_order_statistics(spark, monkeypatch, sketch):
    """All values counted, and brackets of a coarse sketch; ties, tails, infinities, two columns at once."""
    monkeypatch.setattr(quantiles, "SKETCH", sketch)
    monkeypatch.setattr(quantiles, "ERROR", 0.0008 if sketch == 4096 else 0.04)
    monkeypatch.setattr(quantiles, "PARTS", 8)
    r = random.Random(3)
    cases = [
        [r.gauss(0, 1) for _ in range(900)], [1.0] * 700 + [2.0, 3.0], [r.lognormvariate(0, 4) for _ in range(700)], [5.0],
        [-math.inf, math.inf, 1e308, -1e308, 0.0, 1.0] * 30, [float(k % 7) for k in range(500)], [],
    ]
    rows = [(g, v, float(k)) for g, values in enumerate(cases) for k, v in enumerate([*values, None, math.nan])]
    df = spark.createDataFrame(rows, "g int, x double, k double").repartition(3)
    ranks = [*quantiles.between(0.5), *quantiles.nearest(0.99), *quantiles.at_share(0.25), *quantiles.nearest(0.0)]
    for g, values in enumerate(cases):
        made = quantiles.with_order_statistics(df.where(F.col("g") == g), {"x": F.col("x"), "k": F.col("k")}, {"x": ranks, "k": quantiles.nearest(0.5)}, {"rows": F.count("*")}).first()
        n, want = len(values), sorted(values)
        at = [math.floor(0.5 * (n - 1)), math.ceil(0.5 * (n - 1)), math.ceil(0.99 * n) - 1, min(int(0.25 * n), n - 1), 0]
        assert made["rows"] == n + 2 and made["n_x"] == n and made["n_k"] == n + 2
        assert [made[f"x_{i}"] for i in range(5)] == [want[a] if n else None for a in at]
        assert made["k_0"] == math.ceil(0.5 * (n + 2)) - 1


def test_two_scans(spark, sf_dir):
    """Figures and ranks of a column, and headline figures of documents and their amounts, read each table twice."""
    read = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x = F.col("l_extendedprice")
    assert scans(quantiles.with_order_statistics(read, {"x": x}, {"x": quantiles.between(0.5) + quantiles.nearest(0.9)}, {"mean": F.avg(x)})) == 2
    assert scans(kpi.amount_stats(read.withColumn("t", x.cast("string")), "t")) == 2
    docs = read.select(x.cast("string").alias("amount"), F.lit("VERIFIED").alias("status"), F.lit(True).alias("review_required"), F.col("l_discount").alias("overall_confidence"))
    assert scans(kpi.document_figures(docs, docs, "amount", with_confidence=True)) == 2


def test_numbered_in_parts(spark):
    rows = spark.createDataFrame([(g, k) for g in ("a", "b", None) for k in range(50)], "g string, k long")
    made = prefix.numbered(rows, [F.col("k")], "n", ("g",), parts=8).collect()
    assert {(r["g"], r["k"], r["n"]) for r in made} == {(g, k, k + 1) for g in ("a", "b", None) for k in range(50)}
    assert prefix.numbered(rows.limit(0), [F.col("k")], "n").count() == 0


def test_ranges_are_even(spark):
    """Nine of ten rows have one score, one ordinal lies far from all others, and one class has most rows: no range is large."""
    r = random.Random(6)
    rows = [("c" if r.random() < 0.8 else r.choice("ab"), 1.0 if r.random() < 0.9 else r.random(), k, k if k else 10**15) for k in range(20_000)]
    df = spark.createDataFrame(rows, "class_id string, score double, image_id long, ordinal long").repartition(5)
    for order in ([F.col("class_id"), F.desc("score"), F.col("image_id")], [F.col("ordinal")]):
        sizes = [s["n"] for s in prefix.ranges(df, order, 16).groupBy(prefix.PART).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == 16 and max(sizes) <= 2 * sum(sizes) / 16
    made = prefix.numbered(df, [F.col("ordinal")], "n", parts=16).collect()
    assert [m["n"] for m in sorted(made, key=lambda m: m["ordinal"])] == list(range(1, 20_001))


def test_average_precision_with_saturated_scores(spark):
    """Nine of ten scores are 1.0; the curve against a plain computation, in one range and in many."""
    r = random.Random(7)
    rows = [(k // 4, r.randint(1, 2), k, 1.0 if r.random() < 0.9 else round(r.random(), 2), k if r.random() < 0.6 else None, r.choice([0.4, 0.6, 0.8])) for k in range(1500)]
    matched = spark.createDataFrame(rows, "image_id long, class_id int, pred_id long, score double, truth_id long, iou double")
    truths = spark.createDataFrame([(k // 4, 1 + k % 2, k) for k in range(1200)], "image_id long, class_id int, truth_id long")

    def plain(c, t):
        own = sorted((x for x in rows if x[1] == c), key=lambda x: (-x[3], x[0], x[2]))
        points, tp = [(0.0, 0.0)], 0
        for k, x in enumerate(own, 1):
            tp += x[4] is not None and x[5] >= t
            points.append((tp / 600, tp / k))
        points.append((1.0, 0.0))
        envelope = [max(p for _, p in points[i:]) for i in range(len(points))]
        return sum((points[i + 1][0] - points[i][0]) * (envelope[i + 1] + envelope[i]) / 2 for i in range(len(points) - 1))

    for parts in (1, 13):
        got = {(g["class_id"], g["threshold"]): g["ap"] for g in evaluate.average_precision(matched, truths, [0.5, 0.75], parts).collect()}
        assert all(abs(v - plain(c, t)) < 2e-6 for (c, t), v in got.items()) and len(got) == 4


def test_large_groups_of_duplicates_are_not_listed(spark):
    rows = spark.createDataFrame([(k, "x" if k < 5 else "y" if k < 7 else "z" if k < 8 else None) for k in range(9)], "sample_id long, image_hash string")
    made = {r["image_hash"]: (r["n"], r["first_id"], r["ids"]) for r in datasets.duplicate_groups(rows, most=4).collect()}
    assert made == {"x": (5, 0, None), "y": (2, 5, [5, 6])}
    assert {(r["image_hash"], r["sample_id"]) for r in datasets.duplicate_members(rows).collect()} == {("x", k) for k in range(5)} | {("y", 5), ("y", 6)}
