"""A corpus pipeline of four stages: toxic documents go, documents of poor quality go, one document of each group of near
copies stays, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. The stages' rules for nulls, empty texts and repeated rows are those of their operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymill.llm import fertility, near_join, packing, toxicity
from tallymill.llm.tables import settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10, trained on the labelled rows of these documents; thresholds by language."""
    return toxicity.reject(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3."""
    return fertility.reject(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each class of linked documents the one with the smallest id stays, whether ids are null or repeated."""
    return near_join.reject(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9."""
    return packing.pack(docs, "word_bpe_49k.json", end_id=2, length=4096)


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_poor), ("n-gram Jaccard join", drop_near_copies), ("packing", pack)]

#: The stages use tokenizers and trained weights, which SQL cannot express; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
