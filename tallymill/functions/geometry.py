"""Boxes: structs xmin, ymin, xmax, ymax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.struct(xmin.cast("double").alias("xmin"), ymin.cast("double").alias("ymin"), xmax.cast("double").alias("xmax"), ymax.cast("double").alias("ymax"))


def width(b: Column) -> Column:
    return b["xmax"] - b["xmin"]


def height(b: Column) -> Column:
    return b["ymax"] - b["ymin"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def is_valid(b: Column) -> Column:
    return (b["xmax"] > b["xmin"]) & (b["ymax"] > b["ymin"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 if the union is empty."""
    w = F.greatest(F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"]), F.lit(0.0))
    h = F.greatest(F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"]), F.lit(0.0))
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def scaled(b: Column, x: Column, y: Column, pad_x: Column | None = None, pad_y: Column | None = None) -> Column:
    """Coordinates times the scales plus the offsets, rounded half to even."""
    px, py = pad_x if pad_x is not None else F.lit(0), pad_y if pad_y is not None else F.lit(0)
    return box(F.bround(b["xmin"] * x + px), F.bround(b["ymin"] * y + py), F.bround(b["xmax"] * x + px), F.bround(b["ymax"] * y + py))


def clamped(b: Column, w: Column, h: Column, margin: int = 0) -> Column:
    """The box with a margin, within an image."""
    zero = F.lit(0.0)
    return box(F.greatest(b["xmin"] - margin, zero), F.greatest(b["ymin"] - margin, zero), F.least(b["xmax"] + margin, w), F.least(b["ymax"] + margin, h))


def coco(b: Column) -> Column:
    """[x, y, width, height]."""
    return F.array(b["xmin"], b["ymin"], width(b), height(b))


def without_overlap(boxes: Column, gap: int = 3) -> Column:
    """Left to right, a box is kept if it begins more than ``gap`` right of the last kept one."""
    keep = lambda kept, b: F.when((F.size(kept) == 0) | (b["x"] > F.try_element_at(kept, F.lit(-1))["x"] + gap), F.concat(kept, F.array(b))).otherwise(kept)
    return F.aggregate(F.array_sort(boxes), F.slice(boxes, 1, 0), keep)
