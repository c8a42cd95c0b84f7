"""From raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes it as Parquet to the shared checkpoint folder and reads
it again as the next stage's docs, so a lost executor repeats one stage at most. All stages but the last return the columns of
``documents``. Nulls, empty texts, repeated rows and empty tables are treated as the operators say; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from slidegrid.llm import jaccard, language, mixing, quality, segmentation
from slidegrid.session import scratch_folder


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID learned from the labelled documents; texts in no known language go."""
    return language.keep(docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the threshold table go."""
    return quality.keep(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, Jaccard 0.8 or more) the document with the smallest doc_id stays."""
    return jaccard.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their targets: documents are left out or repeated, every copy a row."""
    return mixing.mix(docs, with_place=False)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four best segmentations of every text, with the number of pieces of the best."""
    encoded = segmentation.encode(docs, n=4, keep=("doc_id", "lang", "source"))
    return encoded.withColumn("n_pieces", F.coalesce(F.size("ids"), F.lit(0)).cast("long"))


STAGES = [
    ("language identification", language_stage),
    ("quality rules", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("source mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: The stages hash and learn, which SQL cannot express; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
