"""Readers of the library's inputs, all with explicit schemas."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import box
from ..functions.validate import reject_reason
from ..schemas import BOX
from . import images


def image_files(spark: SparkSession, path: str, pattern: str = "*.{tif,tiff}") -> DataFrame:
    """(sample_id, path, length, image_hash, format, width, height, mode, fault) of image files, the last five from their headers;
    hidden files are skipped by the reader."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    sample = F.replace(F.lower(F.regexp_replace(name, r"\.[^.]*$", "")), F.lit(" "), F.lit("_"))
    return images.facts(files.select(sample.alias("sample_id"), "path", "length", F.sha2("content", 256).alias("image_hash"), "content"))


def there(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder, or a pattern for some, is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place))


def labelled_images(spark: SparkSession, paths: dict[str, str], boxes: tuple[str, ...]) -> DataFrame:
    """Parquet files of one split each, with image.bytes and a struct column for each box: annotations as a map, size and mode
    from the image's header, rows without bytes skipped. A split whose file is not there is left out; without any, no rows."""
    out = spark.createDataFrame([], f"image_hash string, source_split string, annotations map<string,{BOX}>, length long, format string, width int, height int, mode string, fault string")
    for split, path in paths.items():
        if not there(spark, path):
            continue
        rows = spark.read.parquet(path).where("image.bytes is not null")
        held = F.map_from_arrays(F.array(*map(F.lit, boxes)), F.array(*[box(F.col(b)["xmin"], F.col(b)["ymin"], F.col(b)["xmax"], F.col(b)["ymax"]) for b in boxes]))
        made = rows.select(F.sha2("image.bytes", 256).alias("image_hash"), F.lit(split).alias("source_split"), F.map_filter(held, lambda _, v: v["xmin"].isNotNull()).cast(f"map<string,{BOX}>").alias("annotations"), F.octet_length("image.bytes").cast("long").alias("length"), F.col("image.bytes").alias("content"))
        out = out.unionByName(images.facts(made))
    return out


def _literal(answers: pd.Series) -> pd.Series:
    """Dictionaries written as Python literals: names with their values as text, what is nested as JSON; null if it is none."""

    def one(text: str | None) -> dict | None:
        try:
            told = ast.literal_eval(text) if text else None
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None
        if not isinstance(told, dict):
            return None
        shown = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str)
        return {str(k): shown(v) for k, v in told.items()}

    return answers.map(one)


def prompted_rows(rows: DataFrame, exact: str, keywords: str, query: str = "query", answer: str = "answer", category: str | None = None) -> DataFrame:
    """Classifies rows by their prompt (one exact text, else a keyword pattern, else other), keeps one category if it is given, and
    parses answers that are literal dictionaries, nested or with None, True and numbers; any other answer stays as raw text."""
    kind = F.when(F.trim(query) == exact, "handwriting").when(F.rlike(F.lower(query), F.lit(keywords)), "document").otherwise("other")
    kept = rows.withColumn("category", kind)
    kept = kept if category is None else kept.where(F.col("category") == category)
    parsed = F.pandas_udf(_literal, "map<string,string>")(F.col(answer))
    return kept.withColumn("ground_truth", parsed).withColumn("ground_truth", F.coalesce("ground_truth", F.create_map(F.lit("raw_text"), F.col(answer))))


def manifest_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def split_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(id, split) from a JSON object of lists of ids by split."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("split", "ids")).select(F.explode("ids").alias("id"), "split")


def manifest_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("escape", '"').csv(path)


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 32, **options: str) -> DataFrame:
    """A relational table read in ranges of its key."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def ocr_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Word rows of a recogniser's tab-separated output: blank texts dropped, confidences from per cent, none or bad as 0."""
    columns = "level page_num block_num par_num line_num word_num left top width height conf text".split()
    rows = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("sep", "\t").option("header", "true").option("quote", "").csv(path)
    whole = ("line_num", "word_num", "left", "top", "width", "height")
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("conf").try_cast("double"), F.lit(0.0)) / 100))
    return rows.where("level = '5' and trim(text) <> ''").select(*[F.col(c).try_cast("int").alias(c) for c in whole], conf.alias("conf"), F.trim("text").alias("text"))


def landed(files: DataFrame, known_hashes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new, known, rejected) of uploads (name, content): the gates on name and size, then what the header says, then known hashes.
    Of several new uploads with one hash the first by name is new and the others are known."""
    told = images.facts(files.select("name", F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("image_hash"), "content"))
    reason = F.coalesce(reject_reason(F.col("name"), F.col("length"), F.col("width"), F.col("height")), images.fault_reason(F.col("fault")))
    gated = told.withColumn("reject_reason", reason)
    good = gated.where("reject_reason is null")
    first = good.groupBy("image_hash").agg(F.min("name").alias("name")).join(known_hashes.select("image_hash").distinct(), "image_hash", "left_anti")
    new = good.join(first, ["image_hash", "name"], "left_semi").dropDuplicates(["image_hash", "name"])
    return new, good.join(first, ["image_hash", "name"], "left_anti"), gated.where("reject_reason is not null")
