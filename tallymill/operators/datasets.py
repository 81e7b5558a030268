"""Datasets: duplicates, leakage between splits, splits without leakage, manifests and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import prefix


def duplicate_groups(samples: DataFrame, hash_col: str = "image_hash", id_col: str = "sample_id", most: int = 10_000) -> DataFrame:
    """A row for each hash that several samples share: how many, the first id, and the ids in order, for groups of at most
    ``most`` samples. Larger ones have null there, their members are in ``duplicate_members``. Samples without a hash are no
    duplicates. Counts come first, so only ids of groups that may be listed are gathered."""
    some = samples.where(F.coalesce(F.col(hash_col), F.lit("")) != "")
    counted = some.groupBy(hash_col).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).where("n > 1")
    listed = some.join(counted.where(F.col("n") <= most).select(hash_col), hash_col, "left_semi")
    ids = listed.groupBy(hash_col).agg(F.array_sort(F.collect_list(id_col)).alias("ids"))
    return counted.join(ids, hash_col, "left")


def duplicate_members(samples: DataFrame, hash_col: str = "image_hash", id_col: str = "sample_id") -> DataFrame:
    """(hash, id) of every sample whose hash others have too, whatever the size of its group."""
    some = samples.where(F.coalesce(F.col(hash_col), F.lit("")) != "")
    again = some.groupBy(hash_col).agg(F.count("*").alias("n")).where("n > 1").select(hash_col)
    return some.join(again, hash_col, "left_semi").select(hash_col, id_col)


def duplicate_summary(samples: DataFrame, hash_col: str = "image_hash", id_col: str = "sample_id") -> DataFrame:
    counted = samples.where(F.coalesce(F.col(hash_col), F.lit("")) != "").groupBy(hash_col).agg(F.count("*").alias("n")).where("n > 1")
    return counted.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("instances"))


def duplicate_flags(samples: DataFrame, hash_col: str = "image_hash") -> DataFrame:
    """Adds is_duplicate. The hashes that repeat are counted first and joined, so no window holds a hash's rows together."""
    again = samples.where(F.col(hash_col) != "").groupBy(hash_col).agg(F.count("*").alias("__n")).where("__n > 1").select(F.col(hash_col).alias("__hash"), F.lit(True).alias("__again"))
    return samples.join(again, F.col(hash_col) == F.col("__hash"), "left").withColumn("is_duplicate", F.coalesce("__again", F.lit(False))).drop("__hash", "__again")


def leakage(samples: DataFrame, rank: Column, hash_col: str = "image_hash", id_col: str = "sample_id", ordinal: str = "ordinal", split: str = "split") -> DataFrame:
    """Hashes that two splits share: the pair's name and the last sample of each. Each split has a hash once, so a hash makes
    at most one row for each pair of splits."""
    last = samples.where(F.coalesce(F.col(hash_col), F.lit("")) != "").groupBy(split, hash_col).agg(F.max_by(id_col, ordinal).alias("id")).withColumn("rank", rank)
    a = last.select(F.col(hash_col).alias("hash"), F.col(split).alias("split_a"), F.col("id").alias("id_a"), F.col("rank").alias("rank_a"))
    b = last.select(F.col(hash_col).alias("hash"), F.col(split).alias("split_b"), F.col("id").alias("id_b"), F.col("rank").alias("rank_b"))
    return a.join(b, "hash").where("rank_a < rank_b").select("hash", F.concat("split_a", F.lit("_"), "split_b", F.lit("_leakage")).alias("pair"), "id_a", "id_b")


def new_rows(incoming: DataFrame, known: DataFrame, hash_col: str = "image_hash", order: str = "sample_id") -> DataFrame:
    """Rows whose hash is new, one for each hash: the first."""
    first = incoming.groupBy(hash_col).agg(F.min(order).alias(order))
    return incoming.join(first, [hash_col, order], "left_semi").join(known.select(hash_col).distinct(), hash_col, "left_anti")


def known_rows(incoming: DataFrame, known: DataFrame, hash_col: str = "image_hash") -> DataFrame:
    return incoming.join(known.select(hash_col).distinct(), hash_col, "left_semi")


def ranked(rows: DataFrame, key: str, out: str = "rank", by: tuple[str, ...] = (), then: tuple[str, ...] = (), digits: int = 3) -> DataFrame:
    """Adds the rank (from 1) of each row by a uniform hexadecimal key, within ``by`` if given, without a window over a whole
    table or group: rows are numbered within a prefix of the key, and prefixes (a bounded number) by their running count."""
    return numbered(rows, F.substr(F.col(key), F.lit(1), F.lit(digits)), (key, *then), out, by)


def numbered(rows: DataFrame, part: Column, order: tuple[str, ...], out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds running numbers by ``order`` within ``by``. ``part`` splits every group into a bounded number of pieces whose own
    order is that of ``order``; only pieces are numbered by windows."""
    rows = rows.withColumn("__part", part)
    counts = rows.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*by, "__part", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order))
    same = F.col("__part") == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    before = before.select(F.col("__part").alias("__at"), "__before", *[F.col(c).alias(f"__by_{c}") for c in by])
    made = rows.withColumn("__own", own).join(before, same)
    return made.withColumn(out, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before", "__at", *[f"__by_{c}" for c in by])


def leak_free_split(samples: DataFrame, hash_col: str = "image_hash", seed: str = "42", train: float = 0.72, val: float = 0.14) -> DataFrame:
    """(hash, split): unique hashes in a seeded order, cut by exact sizes, so equal contents never part."""
    unique = samples.where(F.coalesce(F.col(hash_col), F.lit("")) != "").select(hash_col).distinct()
    order = ranked(unique.withColumn("__key", F.sha2(F.concat(F.lit(seed), hash_col), 256)), "__key")
    n = order.agg(F.count("*").alias("n"))
    sized = order.join(F.broadcast(n))
    cut = lambda r: F.bround(F.col("n") * r).cast("long")
    return sized.select(hash_col, F.when(F.col("rank") <= cut(train), "train").when(F.col("rank") <= cut(train) + cut(val), "val").otherwise("test").alias("split"))


def stratified_split(samples: DataFrame, category: str = "category", source_split: str = "source_split", id_col: str = "sample_id", ratio: float = 0.10, seed: str = "42") -> DataFrame:
    """Carves a share of each category's train rows out as val; test stays, benchmark becomes evaluation."""
    by = (category, source_split)
    rows = samples.withColumn("__key", F.sha2(F.concat(F.lit(seed), F.col(id_col).cast("string")), 256))
    sizes = samples.groupBy(*by).agg(F.count("*").alias("__n")).select("__n", *[F.col(c).alias(f"__of_{c}") for c in by])
    same = F.col(category).eqNullSafe(F.col(f"__of_{category}")) & F.col(source_split).eqNullSafe(F.col(f"__of_{source_split}"))
    rows = ranked(rows, "__key", "__rank", by, (id_col,)).join(sizes, same)
    carved = (F.col(source_split) == "train") & (F.col("__rank") <= F.bround(F.col("__n") * ratio))
    split = F.when(carved, "val").when(F.col(source_split) == "benchmark", "evaluation").otherwise(F.col(source_split))
    return rows.withColumn("split", split).select(*samples.columns, "split")


def split_counts(samples: DataFrame, by: tuple[str, ...], hash_col: str = "image_hash") -> DataFrame:
    return samples.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct(hash_col).alias("unique_hashes"))


def merge_mappings(*mappings: DataFrame) -> DataFrame:
    """(id, split) where a later mapping overrides an earlier one."""
    ranked_ = [m.select("id", "split", F.lit(i).alias("rank")) for i, m in enumerate(mappings)]
    out = ranked_[0]
    for m in ranked_[1:]:
        out = out.unionByName(m)
    return out.groupBy("id").agg(F.max_by("split", "rank").alias("split"))


def manifest(samples: DataFrame, splits: DataFrame, hash_col: str = "image_hash") -> DataFrame:
    """Samples with split (else the source's, else 'unsplit'), duplicate flag and group."""
    out = duplicate_flags(samples, hash_col).join(splits.select(F.col("id").alias("sample_id"), F.col("split").alias("__split")), "sample_id", "left")
    group = F.when(F.col("is_duplicate"), F.concat(F.lit("dup_"), F.substr(F.col(hash_col), F.lit(1), F.lit(12))))
    return out.withColumn("split", F.coalesce("__split", "source_split", F.lit("unsplit"))).withColumn("duplicate_group", group).drop("__split")


def flattened(rows: DataFrame) -> DataFrame:
    """Nested columns as text, for CSV: arrays of text joined by |, maps and structs as JSON, null text empty."""
    def column(f) -> Column:
        kind = f.dataType.typeName()
        if kind == "array" and f.dataType.elementType.typeName() == "string":
            return F.coalesce(F.array_join(f.name, "|"), F.lit("")).alias(f.name)
        if kind in ("array", "map", "struct"):
            return F.coalesce(F.to_json(f.name), F.lit("")).alias(f.name)
        return F.coalesce(f.name, F.lit("")).alias(f.name) if kind == "string" else F.col(f.name)

    return rows.select(*[column(f) for f in rows.schema])


def coco_annotations(samples: DataFrame, categories: list[str], ordinal: str = "ordinal") -> DataFrame:
    """A row for each valid box of samples (sample_id, split, ordinal, annotations map): running ids, category, [x,y,w,h], area."""
    number = F.create_map(*[x for i, c in enumerate(categories) for x in (F.lit(c), F.lit(i + 1))])
    boxes = samples.select("sample_id", "split", ordinal, F.explode("annotations").alias("field", "box"))
    rows = boxes.withColumn("category_id", F.try_element_at(number, F.col("field"))).where(F.col("category_id").isNotNull() & G.is_valid(F.col("box")))
    made = prefix.numbered(rows, [F.col(ordinal), F.col("category_id")], "annotation_id", ("split",))
    return made.select("split", F.col("annotation_id").cast("long").alias("annotation_id"), "sample_id", "category_id", G.coco(F.col("box")).alias("bbox"), G.area(F.col("box")).alias("area"))


def coco_images(samples: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The images section: running ids from 1 within each split, in the samples' order; what has no size is no image."""
    sized = samples.where((F.col("width") > 0) & (F.col("height") > 0))
    made = prefix.numbered(sized, [F.col(ordinal)], "image_id", ("split",))
    return made.select("split", F.col("image_id").cast("long").alias("image_id"), "sample_id", "file_name", "width", "height")


def coco_categories(spark: SparkSession, categories: list[str]) -> DataFrame:
    """The categories section, ids from 1 in the order given."""
    named = spark.range(len(categories)).select((F.col("id") + 1).cast("int").alias("category_id"))
    return named.select("category_id", F.element_at(F.array(*map(F.lit, categories)), F.col("category_id")).alias("name"))


def coco_sections(samples: DataFrame, categories: list[str], splits: tuple[str, ...] = ("train", "val", "test"), ordinal: str = "ordinal") -> dict[str, DataFrame]:
    """The three sections of an export, with ids that run over all splits in the samples' order: images (image_id, split, …),
    annotations, each with its image's id, and categories. A sample of another split is no image; boxes of unknown fields or
    without an area are no annotations. A split's file has its images and annotations and all categories."""
    kept = samples.where(F.col("split").isin(*splits))
    images = prefix.numbered(kept, [F.col(ordinal)], "image_id").withColumn("image_id", F.col("image_id").cast("long"))
    number = F.create_map(*[x for i, c in enumerate(categories) for x in (F.lit(c), F.lit(i + 1))])
    boxes = images.select("split", "image_id", F.explode("annotations").alias("field", "box")).withColumn("category_id", F.try_element_at(number, F.col("field")))
    rows = prefix.numbered(boxes.where(F.col("category_id").isNotNull() & G.is_valid(F.col("box"))), [F.col("image_id"), F.col("category_id")], "annotation_id")
    annotations = rows.select("split", F.col("annotation_id").cast("long"), "image_id", "category_id", G.coco(F.col("box")).alias("bbox"), G.area(F.col("box")).alias("area"), F.lit(0).alias("iscrowd"))
    return {"images": images.drop("annotations"), "annotations": annotations, "categories": coco_categories(samples.sparkSession, categories)}


def sample_issues(samples: DataFrame) -> DataFrame:
    """Adds issues: bad dimensions, dimensions that differ from the decoded ones, boxes out of order or of the image, empty text."""
    boxes = F.map_entries(F.coalesce("annotations", F.create_map().cast(samples.schema["annotations"].dataType)))
    def told(text: str, wrong) -> Column:
        return F.transform(F.filter(boxes, lambda e: wrong(e["value"])), lambda e: F.concat(F.lit(text), e["key"]))
    w, h = F.col("width"), F.col("height")
    plain = F.array_compact(F.array(
        F.when(~((w > 0) & (h > 0)), "invalid dimensions"),
        F.when((w != F.col("decoded_width")) | (h != F.col("decoded_height")), "dimensions differ from the image"),
        F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty text"),
    )).cast("array<string>")
    issues = F.concat(plain, told("invalid x-range: ", lambda b: b["xmax"] <= b["xmin"]), told("invalid y-range: ", lambda b: b["ymax"] <= b["ymin"]), told("box outside image: ", lambda b: (b["xmin"] < 0) | (b["ymin"] < 0) | (b["xmax"] > w) | (b["ymax"] > h)))
    return samples.withColumn("issues", issues)


def audit(samples: DataFrame, leaks: DataFrame | None = None) -> DataFrame:
    """One row: samples in all, without and with issues, how often each kind of issue occurs, and whether splits share contents."""
    judged = sample_issues(samples)
    bad = F.size("issues") > 0
    counted = judged.agg(F.count("*").alias("total"), F.count_if(~bad).alias("valid"), F.count_if(bad).alias("corrupt"))
    kinds = judged.select(F.explode("issues").alias("issue")).groupBy(F.regexp_replace("issue", ":.*", "").alias("kind")).agg(F.count("*").alias("n"))
    told = counted.join(kinds.agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("details")))
    if leaks is None:
        return told.withColumn("has_leakage", F.lit(False))
    return told.join(leaks.agg((F.count("*") > 0).alias("has_leakage")))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds violations: the names of the rules that do not hold; a rule on null does not."""
    return rows.withColumn("violations", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])).cast("array<string>"))


def of_kind(samples: DataFrame, dataset: str | None = None, kind: str | None = None, dataset_col: str = "dataset", kind_col: str = "annotation_type") -> DataFrame:
    """Samples of a dataset, of a kind of annotation, or of both."""
    if dataset is not None:
        samples = samples.where(F.col(dataset_col) == dataset)
    return samples if kind is None else samples.where(F.col(kind_col) == kind)


def with_samples(manifest: DataFrame, samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """Manifest rows with what their sample has besides; rows whose sample there is not are left out."""
    more = [c for c in samples.columns if c not in manifest.columns]
    return manifest.join(samples.select(key, *more), key)


def united(**datasets: DataFrame) -> DataFrame:
    """All samples of several datasets, each with its dataset's name; columns that one lacks are null."""
    parts = [rows.withColumn("dataset", F.lit(name)) for name, rows in datasets.items()]
    out = parts[0]
    for rows in parts[1:]:
        out = out.unionByName(rows, allowMissingColumns=True)
    return out


def label_lists(samples: DataFrame, by: str, annotations: str = "annotations") -> DataFrame:
    """The labels that the samples of each class have, in order. Labels are few, so a class's list is short."""
    labels = samples.select(by, F.explode(F.map_keys(annotations)).alias("label")).distinct()
    return labels.groupBy(by).agg(F.array_sort(F.collect_list("label")).alias("labels"))


def merged_maps(rows: DataFrame, key: str, maps: str, position: str) -> DataFrame:
    """(key, name, value): the maps of a key as one; a later map's value wins."""
    told = rows.select(key, position, F.explode(maps).alias("name", "value"))
    return told.groupBy(key, "name").agg(F.max_by("value", position).alias("value"))
