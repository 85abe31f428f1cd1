"""Exact de-duplication: 128-bit content hash, smallest stable id, byte comparison inside groups.

Plan. One narrow pass hashes every normalised text; only (hash, count, smallest id) is aggregated, with
map-side combination, so a group with a third of all rows costs one row for each task. Rows whose hash is
unique leave without any shuffle of text. Texts of repeated hashes only are grouped by (hash, text): the
equality of group and join keys is a comparison of all bytes, so a collision splits the group. In that join the
rows of a large group are dealt over salts (`SALT_ROWS` rows to a salt), each of which gets the group's one summed row.

Defined cases: null text counts as empty; empty texts are equal to each other; rows that share one doc_id
are one document (all of them stay if it is the smallest id of the group); a null doc_id sorts last and
stays only if its group has no other id; extra columns are passed through `deduplicate`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, documents, materialise, maybe_broadcast, salts


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: row (the input as a struct), id, keep_id, group_size, kept, norm_text."""
    base = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), normalised(docs[text_col]).alias("norm_text")
    ).withColumn("h", F.unhex(F.md5(F.encode("norm_text", "UTF-8"))))
    repeated = materialise(base.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", salts(F.col("n")).alias("salts")), "exact-hashes")
    hot = maybe_broadcast(repeated)
    alone = base.join(hot, "h", "left_anti").select(
        "row", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "norm_text"
    )
    members = base.join(hot, "h").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")))
    exact = members.groupBy("h", "norm_text").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.max("salts").alias("salts"))
    exact = exact.select("h", "norm_text", "keep_id", "group_size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    copies = members.join(exact, ["h", "salt", "norm_text"]).select(
        "row", "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "norm_text"
    )
    return alone.unionByName(copies)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the input's columns."""
    return exact_groups(docs, id_col, text_col).filter("kept").select("row.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir).select("doc_id", "text")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.sha2(F.encode("norm_text", "UTF-8"), 256).alias("text_sha256")
    )


OP10_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
