"""From recognised tokens and glyphs to fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def token_rollup(tokens: DataFrame, key: str = "field_id") -> DataFrame:
    """Text in reading order, mean and least confidence and number of tokens (key, line_num, word_num, text, conf)."""
    words = F.array_sort(F.collect_list(F.struct("line_num", "word_num", "text")))
    return tokens.groupBy(key).agg(F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("text"), F.round(F.avg("conf"), 4).alias("mean_confidence"), F.round(F.min("conf"), 4).alias("min_confidence"), F.count("*").alias("tokens"))


def glyph_rollup(glyphs: DataFrame, key: str = "field_id") -> DataFrame:
    """Left to right (key, x, label, conf)."""
    signs = F.array_sort(F.collect_list(F.struct("x", "label")))
    return glyphs.groupBy(key).agg(F.array_join(F.transform(signs, lambda g: g["label"].cast("string")), "").alias("text"), F.round(F.avg("conf"), 4).alias("mean_confidence"))


def deoverlapped(boxes: DataFrame, key: str = "field_id", gap: int = 3) -> DataFrame:
    """Boxes (key, x, w) of a field that begin more than the gap right of the last kept one."""
    made = boxes.groupBy(key).agg(F.collect_list(F.struct("x", "w")).alias("boxes"))
    return made.select(key, G.without_overlap(F.col("boxes"), gap).alias("kept"))


def paired_glyphs(fields: DataFrame, key: str = "field_id", boxes: str = "kept", label: str = "label") -> DataFrame:
    """Glyphs with the label's characters, left to right, where both have the same number."""
    signs = F.filter(F.split(label, ""), lambda c: c != "")
    same = fields.where(F.size(boxes) == F.length(label))
    return same.select(key, F.posexplode(F.arrays_zip(F.col(boxes).alias("box"), signs.alias("sign"))).alias("position", "pair")).select(key, "position", F.col("pair.box").alias("box"), F.col("pair.sign").alias("sign"))
