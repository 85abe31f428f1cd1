"""Edges, safety profiles, comparisons and statistics of the knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import evidence_multiplier, evidence_priority


def edges_of_indications(edges: DataFrame, botanicals: DataFrame, min_evidence: str | None = None) -> DataFrame:
    """Edges with their remedy; with min_evidence only those of at least that priority."""
    if min_evidence:
        edges = edges.filter(evidence_priority(F.col("evidence_level")) >= evidence_priority(F.lit(min_evidence)))
    b = botanicals.select(F.col("id").alias("botanical_id"), "latin_binomial", "family")
    return edges.join(b, "botanical_id")


def edges_of_botanicals(edges: DataFrame, indications: DataFrame) -> DataFrame:
    i = indications.select(F.col("id").alias("indication_id"), "indication_text", "category")
    return edges.join(i, "indication_id")


def safety_profiles(botanicals: DataFrame, contraindications: DataFrame, interactions: DataFrame) -> DataFrame:
    """botanical_id, counts and the critical flag. Each side is summed before the join, so rows don't multiply."""
    c = contraindications.groupBy("botanical_id").agg(F.count(F.lit(1)).alias("n_contra"), F.bool_or(F.col("severity") == "absolute").alias("absolute"))
    d = interactions.groupBy("botanical_id").agg(F.count(F.lit(1)).alias("n_interactions"), F.bool_or(F.col("interaction_severity") == "severe").alias("severe"))
    ids = botanicals.select(F.col("id").alias("botanical_id"), "latin_binomial")
    out = ids.join(c, "botanical_id", "left").join(d, "botanical_id", "left")
    no = F.lit(False)
    return out.select(
        "botanical_id",
        "latin_binomial",
        F.coalesce("n_contra", F.lit(0)).cast("long").alias("n_contra"),
        F.coalesce("n_interactions", F.lit(0)).cast("long").alias("n_interactions"),
        (F.coalesce("absolute", no) | F.coalesce("severe", no)).alias("critical"),
    )


def compare(edges: DataFrame, botanicals: DataFrame, indications: DataFrame, names: list[str]) -> DataFrame:
    """Indications that several of the named remedies share, and which; distinct remedies count."""
    b = botanicals.filter(F.col("latin_binomial").isin(*names)).select(F.col("id").alias("botanical_id"), "latin_binomial")
    e = edges.join(F.broadcast(b), "botanical_id").join(indications.select(F.col("id").alias("indication_id"), "indication_text"), "indication_id")
    out = e.groupBy("indication_text").agg(F.array_sort(F.collect_set("latin_binomial")).alias("names"))
    return out.filter(F.size("names") > 1)


def unique_indications(edges: DataFrame, botanicals: DataFrame, indications: DataFrame, names: list[str]) -> DataFrame:
    b = botanicals.filter(F.col("latin_binomial").isin(*names)).select(F.col("id").alias("botanical_id"), "latin_binomial")
    e = edges.join(F.broadcast(b), "botanical_id").join(indications.select(F.col("id").alias("indication_id"), "indication_text"), "indication_id")
    out = e.groupBy("indication_text").agg(F.collect_set("latin_binomial").alias("n"))
    return out.filter(F.size("n") == 1).select(F.get("n", 0).alias("latin_binomial"), "indication_text")


def primary_evidence(scored: DataFrame) -> DataFrame:
    """botanical_id and the level that adds most to its score (ties: the higher multiplier, then the name)."""
    by = scored.groupBy("botanical_id", "evidence_level").agg(F.sum("score").alias("s"))
    order = F.struct(F.round("s", 6), evidence_multiplier(F.col("evidence_level")), "evidence_level")
    return by.groupBy("botanical_id").agg(F.max_by("evidence_level", order).alias("primary_evidence"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def spread(df: DataFrame, key: str = "id") -> DataFrame:
    """df dealt over all cores by key if it is less than a full split for each core: a small table often is one row group, which
    one task would read and work on alone. Larger tables have splits enough and are not shuffled."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if size < cores * split else df


def exploded(df: DataFrame, array: Column, *keep: str | Column, name: str = "x") -> DataFrame:
    """keep, and a row for each member of the array. The plain explode would have its whole array computed again, in a filter on its size.
    Members are never null."""
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
