"""Rank fusion of lexical and vector hits, for a table of queries: reciprocal ranks, weighted scores, interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values

LEXICAL_DEPTH = 50


def sides(lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """query_id, id with the rank and score of each side: one full outer equi-join."""
    a = lexical.select("query_id", "id", F.col("rank").alias("lex_rank"), F.col("score").alias("lex_score"))
    b = vector.select("query_id", "id", F.col("rank").alias("vec_rank"), F.col("score").alias("vec_score"))
    return a.join(b, ["query_id", "id"], "full_outer")


def cut(scored: DataFrame, limit: int, digits: int | None, order=None) -> DataFrame:
    s = F.round("score", digits) if digits is not None else F.col("score")
    first = F.coalesce(F.col("lex_rank"), F.lit(LEXICAL_DEPTH) + F.col("vec_rank"))
    by = order if order is not None else [F.desc("score"), first]
    out = scored.withColumn("score", s).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by, F.col("id"))))
    return out.filter(F.col("rank") <= limit).select("query_id", "id", "score", "rank", "match_type")


def present():
    both = F.col("lex_rank").isNotNull() & F.col("vec_rank").isNotNull()
    return F.when(both, "hybrid").when(F.col("lex_rank").isNotNull(), "lexical").otherwise("vector")


def rrf(lexical: DataFrame, vector: DataFrame, limit: int = 20, k: int = values.RRF_K, digits: int | None = None) -> DataFrame:
    one = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    return cut(sides(lexical, vector).withColumn("score", one("lex_rank") + one("vec_rank")).withColumn("match_type", present()), limit, digits)


def weighted(lexical: DataFrame, vector: DataFrame, limit: int = 20, lexical_weight: float = values.LEXICAL_WEIGHT, vector_weight: float = values.VECTOR_WEIGHT, digits: int | None = None) -> DataFrame:
    one = lambda c, w: F.when(F.col(c) > 0, F.col(c) * w).otherwise(0.0)
    kind = F.when((F.col("lex_score") > 0) & (F.col("vec_score") > 0), "hybrid").when(F.col("lex_score") > 0, "lexical").otherwise("vector")
    got = sides(lexical, vector).withColumn("score", one("lex_score", lexical_weight) + one("vec_score", vector_weight)).withColumn("match_type", kind)
    return cut(got, limit, digits)


def interleave(lexical: DataFrame, vector: DataFrame, limit: int = 20, digits: int | None = None) -> DataFrame:
    """Lexical and vector hits by turns; an id keeps its first place."""
    a, b = F.coalesce(2 * (F.col("lex_rank") - 1), F.lit(1 << 30)), F.coalesce(2 * (F.col("vec_rank") - 1) + 1, F.lit(1 << 30))
    got = sides(lexical, vector).withColumn("place", F.least(a, b))
    got = got.withColumn("match_type", F.when(a < b, "lexical").otherwise("vector")).withColumn("score", F.when(a < b, F.col("lex_score")).otherwise(F.col("vec_score")))
    return cut(got, limit, digits, order=[F.col("place")])


METHODS = {"rrf": rrf, "weighted": weighted, "interleave": interleave}


def fuse(lexical: DataFrame, vector: DataFrame, method: str = "rrf", **params) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown fusion method {method}")
    return METHODS[method](lexical, vector, **params)
