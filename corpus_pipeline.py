"""The corpus pipeline: five operators of the llm subpackage, each stage written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wellspring.llm import bpe, line_dedup, mixing, near_dedup, quality_crf
from wellspring.llm.common import documents, materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.3 or more; learned from the labelled rows of `docs` that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_crf.keep_good(docs, quality_crf.fit(*quality_crf.training_rows(docs, labels)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without chunks of lines that an earlier document has; n_chars follows the text."""
    from pyspark.sql import functions as F

    got = line_dedup.deduplicate(docs)
    return got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with raked weights of sources, languages and topics."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_digests(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near dedup", near), ("mixing", mix), ("bpe", encode)]

#: The classifier and the MinHash stage can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
