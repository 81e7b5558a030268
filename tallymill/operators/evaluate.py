"""Evaluation of stored predictions: classes, texts, and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..functions import validate as V
from ..functions.money import share
from . import prefix


def confusion_matrix(pairs: DataFrame, classes: int, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """(truth, predicted, n) of every cell, zeros included; labels outside the classes are left out. Cells number the square
    of the classes, a parameter, and never depend on the rows."""
    one = pairs.sparkSession.range(classes)
    cells = one.select(F.col("id").cast("int").alias("truth"), F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("predicted"))
    counted = pairs.groupBy(F.col(truth).cast("int").alias("truth"), F.col(predicted).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    return cells.join(counted, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Support, TP, FP, FN, precision, recall and F1 of each class; 0 where a denominator is 0."""
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    rows = matrix.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    columns = matrix.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("named"))
    made = rows.join(columns, "class").select("class", "support", "tp", (F.col("named") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"))
    made = made.withColumn("p", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("r", share(F.col("tp"), F.col("support")))
    f1 = share(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    return made.select("class", "support", "tp", "fp", "fn", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f1, 4).alias("f1"))


def macro_metrics(pairs: DataFrame, metrics: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Accuracy over all rows; means over classes with support; F1 weighted by support."""
    means = metrics.where("support > 0").agg(F.round(F.avg("precision"), 4).alias("macro_precision"), F.round(F.avg("recall"), 4).alias("macro_recall"), F.round(F.avg("f1"), 4).alias("macro_f1"), F.round(share(F.sum(F.col("f1") * F.col("support")), F.sum("support")), 4).alias("weighted_f1"))
    right = pairs.agg(F.count("*").alias("n"), F.round(share(F.count_if(F.col(truth) == F.col(predicted)), F.count("*")), 4).alias("accuracy"))
    return right.join(means)


def confusing_pairs(matrix: DataFrame, n: int = 10) -> DataFrame:
    return matrix.where("truth <> predicted and n > 0").orderBy(F.desc("n"), "truth", "predicted").limit(n)


def error_cases(pairs: DataFrame, truth: str = "truth", predicted: str = "predicted", confidence: str = "confidence", threshold: float = V.LOW_CONFIDENCE) -> DataFrame:
    """Rows that are wrong or unsure, and which."""
    rows = pairs.withColumn("incorrect", F.col(truth) != F.col(predicted)).withColumn("low_confidence", F.col(confidence) < threshold)
    return rows.where("incorrect or low_confidence")


def text_pairs(truths: DataFrame, predictions: DataFrame, key: list[str], truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Truths with their prediction, empty if there is none; truths without text are not judged."""
    out = truths.where(F.coalesce(F.col(truth), F.lit("")) != "").join(predictions, key, "left")
    return out.withColumn(predicted, F.coalesce(predicted, F.lit("")))


def scored(pairs: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    a, b = X.comparison_key(F.col(truth)), X.comparison_key(F.col(predicted))
    return pairs.withColumns({"exact": X.exact_match(F.col(truth), F.col(predicted)), "similarity": X.similarity(a, b), "char_errors": X.character_errors(a, b), "chars": F.greatest(F.length(a), F.lit(1))})


def extraction_accuracy(scored_pairs: DataFrame, field: str = "field", predicted: str = "predicted") -> DataFrame:
    there = F.avg((F.trim(predicted) != "").cast("double"))
    return scored_pairs.groupBy(field).agg(F.count("*").alias("n"), F.round(there, 4).alias("presence_rate"), F.round(F.avg(F.col("exact").cast("double")), 4).alias("exact_rate"), F.round(F.avg("similarity"), 4).alias("mean_similarity"))


def text_error_rates(scored_pairs: DataFrame) -> DataFrame:
    exact = share(F.count_if("exact"), F.count("*"))
    cer = F.least(F.lit(1.0), share(F.sum("char_errors"), F.sum("chars")))
    return scored_pairs.agg(F.count("*").alias("n"), F.round(exact, 4).alias("exact_match"), F.round(1 - exact, 4).alias("wer"), F.round(cer, 4).alias("cer"), F.round(1 - cer, 4).alias("char_accuracy"))


def failure_modes(scored_pairs: DataFrame, w: Column, h: Column, method: Column, confidence: Column, predicted: str = "predicted") -> DataFrame:
    """Counts of every category among the pairs that are not exact, zeros included, and those of low confidence."""
    wrong = scored_pairs.where(~F.col("exact")).select(V.failure_category(w, h, method, F.col(predicted)).alias("category"), (confidence < 0.60).alias("unsure"))
    names = ["handwriting_recognition_error", "poor_image_quality_low_resolution", "field_detection_miss", "ocr_background_interference"]
    made = wrong.agg(*[F.count_if(F.col("category") == c).alias(c) for c in names], F.count_if("unsure").alias("low_confidence_review_trigger"))
    return made.unpivot([], [*names, "low_confidence_review_trigger"], "category", "n")


def best_boxes(predictions: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The surest box of each class in an image; the first of equals."""
    own = Window.partitionBy("image_id", "class_id").orderBy(F.desc("score"), ordinal)
    return predictions.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")


def matches(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """Each prediction (image_id, class_id, pred_id, score, box) with the truth (…, truth_id, box) that it overlaps most, and how
    much; equal overlaps go to the first truth. Images have few boxes, so the join within image and class stays small."""
    t = truths.select("image_id", "class_id", "truth_id", F.col("box").alias("truth_box"))
    both = predictions.join(t, ["image_id", "class_id"], "left").withColumn("iou", F.coalesce(G.iou(F.col("box"), F.col("truth_box")), F.lit(0.0)))
    own = Window.partitionBy("image_id", "class_id", "pred_id").orderBy(F.desc("iou"), "truth_id")
    return both.withColumn("__n", F.row_number().over(own)).where("__n = 1").select("image_id", "class_id", "pred_id", "score", "truth_id", "iou")


def claimed(matched: DataFrame) -> DataFrame:
    """Adds taken: the best overlap with the same truth among surer predictions. A prediction is the surest with enough overlap,
    and so a true positive, at every threshold above taken and up to its own overlap: one window serves all thresholds."""
    surer = Window.partitionBy("class_id", "image_id", "truth_id").orderBy(F.desc("score"), "pred_id").rowsBetween(Window.unboundedPreceding, -1)
    return matched.withColumn("taken", F.coalesce(F.max("iou").over(surer), F.lit(-1.0)))


def _positive(threshold: Column) -> Column:
    return (F.col("truth_id").isNotNull() & (F.col("iou") >= threshold) & (F.col("taken") < threshold)).cast("int")


def hits(matched: DataFrame, thresholds: list[float]) -> DataFrame:
    """A row for each prediction and threshold with tp: enough overlap, and the surest of those with the same truth."""
    rows = claimed(matched).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return rows.withColumn("tp", _positive(F.col("threshold"))).drop("taken")


def detection_metrics(hit: DataFrame, truths: DataFrame, threshold: float = 0.5) -> DataFrame:
    counted = hit.where(F.col("threshold") == threshold).groupBy("class_id").agg(F.count("*").alias("predictions"), F.sum("tp").alias("tp"))
    made = truths.groupBy("class_id").agg(F.count("*").alias("truths")).join(counted, "class_id", "left").na.fill(0, ["predictions", "tp"])
    p, r = share(F.col("tp"), F.col("predictions")), share(F.col("tp"), F.col("truths"))
    return made.select("class_id", "truths", "predictions", "tp", (F.col("predictions") - F.col("tp")).alias("fp"), (F.col("truths") - F.col("tp")).alias("fn"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(share(2 * p * r, p + r), 4).alias("f1"))


def average_precision(matched: DataFrame, truths: DataFrame, thresholds: list[float], parts: int | None = None) -> DataFrame:
    """(class_id, threshold, ap) of classes with truths: area under the falling envelope of precision over recall, by
    trapezoids between the points and the ends (0, 0) and (1, 0).

    The predictions are dealt in ``parts`` ranges of about equally many, surest first within a class; equal scores are split by
    image and prediction. All thresholds run side by side: counts of predictions and hits are carried from the ranges before,
    the best precision from those behind, so no task sees a whole class. Only true positives move the recall, and the point
    before one is known from its own counts."""
    which = range(len(thresholds))
    columns = lambda name: [f"{name}_{i}" for i in which]
    key, part = ("class_id",), prefix.PART
    n = truths.groupBy("class_id").agg(F.count("*").alias("truths"))
    rows = claimed(matched.join(n.select("class_id"), "class_id", "left_semi"))
    rows = rows.select("class_id", "score", "image_id", "pred_id", *[_positive(F.lit(t)).alias(f"tp_{i}") for i, t in enumerate(thresholds)])
    order = [F.desc("score"), F.col("image_id"), F.col("pred_id")]
    rows = prefix.ranges(rows, [F.col("class_id"), *order], parts)
    sizes = rows.groupBy("class_id", part).agg(F.count("*").alias("n"), *[F.sum(f"tp_{i}").alias(f"hits_{i}") for i in which])
    before = prefix.carried(sizes, key, {f"{c}_above": F.sum(c) for c in ("n", *columns("hits"))})
    own = Window.partitionBy("class_id", part).orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    counted = prefix.joined(rows.select("*", F.row_number().over(own).alias("k"), *[F.sum(f"tp_{i}").over(upto).alias(f"hits_{i}") for i in which]), before, key)
    above = lambda c: F.col(c) + F.coalesce(f"{'n' if c == 'k' else c}_above", F.lit(0))
    points = counted.withColumns({c: above(c) for c in ("k", *columns("hits"))})
    points = points.select("class_id", part, "k", *columns("tp"), *columns("hits"), *[(F.col(f"hits_{i}") / F.col("k")).alias(f"precision_{i}") for i in which])
    best = points.groupBy("class_id", part).agg(*[F.max(f"precision_{i}").alias(f"best_{i}") for i in which])
    behind = prefix.carried(best, key, {}, {f"behind_{i}": F.max(f"best_{i}") for i in which})
    # read from the end, so that the frame only grows: one that shrinks would be scanned anew for each row
    back = Window.partitionBy("class_id", part).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    line = prefix.joined(points.select("*", *[F.max(f"precision_{i}").over(back).alias(f"own_{i}") for i in which]), behind, key)

    def area(i: int) -> Column:
        envelope = F.greatest(f"own_{i}", F.coalesce(f"behind_{i}", F.lit(0.0)))
        earlier = F.greatest(envelope, F.coalesce(F.try_divide(F.col(f"hits_{i}") - 1, F.col("k") - 1), F.lit(0.0)))
        return F.sum(F.when(F.col(f"tp_{i}") == 1, (envelope + earlier) / 2)).alias(f"area_{i}")

    areas = line.groupBy("class_id").agg(*map(area, which))
    ends = sizes.groupBy("class_id").agg(F.sum("n").alias("n"), *[F.sum(f"hits_{i}").alias(f"hits_{i}") for i in which])
    made = n.join(ends, "class_id", "left").join(areas, "class_id", "left")

    def ap(i: int) -> Column:
        last = (1 - F.col(f"hits_{i}") / F.col("truths")) * (F.col(f"hits_{i}") / F.col("n")) / 2
        return F.round(F.coalesce(F.col(f"area_{i}"), F.lit(0.0)) / F.col("truths") + F.coalesce(last, F.lit(0.0)), 6)

    curves = F.array(*[F.struct(F.lit(t).alias("threshold"), ap(i).alias("ap")) for i, t in enumerate(thresholds)])
    return made.select("class_id", F.inline(curves))


def above_threshold(predictions: DataFrame, threshold: float = 0.3, classes: list[int] | None = None, background: int = 0) -> DataFrame:
    """Predictions that count: scores from the threshold up, no background, and only known classes if these are given."""
    kept = predictions.where((F.col("score") >= threshold) & (F.col("class_id") != background))
    return kept if classes is None else kept.where(F.col("class_id").isin(*classes))


def mean_average_precision(ap: DataFrame) -> DataFrame:
    at50 = F.avg(F.when(F.col("threshold") == 0.5, F.col("ap")))
    return ap.agg(F.round(at50, 4).alias("map_50"), F.round(F.avg("ap"), 4).alias("map_50_95"))


def macro_detection(metrics: DataFrame) -> DataFrame:
    """Means of precision, recall and F1 over the classes with truths."""
    return metrics.where("truths > 0").agg(F.count("*").alias("classes"), *[F.round(F.avg(c), 4).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def first_errors(cases: DataFrame, ordinal: str = "ordinal", limit: int = 60) -> DataFrame:
    """The first error cases in the samples' order, for a report: the number is the feature."""
    return cases.orderBy(ordinal).limit(limit)
