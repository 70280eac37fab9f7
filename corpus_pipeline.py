"""The training-data pipeline: stages over ``documents``, each written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import decontaminate, jaccard, langid, mixing, sharding
from skein.llm.common import discard, scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the others go.

    Null, empty and letterless texts go; repeated rows go or stay alike; without labelled
    rows nothing can be identified and all go; an empty table stays empty.
    """
    return langid.drop_unidentified(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    Rows are told apart by id and text, rows without an id come behind the others, rows
    without words all stay; an empty table stays empty.
    """
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window.

    Null and empty texts hold none; repeated rows go or stay alike; an empty benchmark
    drops nothing; an empty table stays empty.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (whole documents), at most twice.

    Documents without words are never taken; a null source is a source of its own; rows
    that agree in id, source and size share their number; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their slot and shard; columns of these names are replaced.

    Rows that repeat an id share a shard, a null id is a key like others; null and empty
    texts are rows like others; an empty table stays empty.
    """
    return sharding.place(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("sharding", shard),
]

#: The language model has no SQL form; ``tests/llm`` checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages; each result is written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
