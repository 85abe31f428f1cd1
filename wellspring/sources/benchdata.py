"""The knowledge-base tables derived from the benchmark's star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def botanicals(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("family"))
    return (
        read(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("latin_binomial"), "family")
    )


def indications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("indication_text"),
        F.lower("p_name").alias("normalized_text"),
        F.lower("p_type").alias("category"),
    )


LEVELS = {"AO": "systematic_review", "AF": "clinical_trial", "RF": "clinical_observation", "RO": "traditional", "NO": "in_vitro", "NF": "ethnobotanical"}


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.concat("l_returnflag", "l_linestatus")
    table = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("indication_id"),
        F.col("l_suppkey").alias("botanical_id"),
        F.col("l_quantity").alias("weight"),
        F.coalesce(F.element_at(table, flags), F.lit("traditional")).alias("evidence_level"),
        F.lit("").alias("preparation"),
        F.col("l_orderkey").alias("source_ref"),
        F.col("l_linenumber").alias("line"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each (indication, botanical, preparation); the pick is combined before the shuffle."""
    return (
        raw_edges(spark, sf_dir)
        .groupBy("indication_id", "botanical_id", "preparation")
        .agg(F.max_by(F.struct("weight", "evidence_level", "source_ref"), F.struct("source_ref", "line", "weight", "evidence_level")).alias("e"))
        .select("indication_id", "botanical_id", "preparation", "e.*")
    )


def contraindications(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))
    severity = F.when(F.col("o_orderpriority").startswith("1"), "absolute").when(F.col("o_orderpriority").startswith("2"), "severe")
    severity = severity.when(F.col("o_orderpriority").startswith("3"), "moderate").otherwise("mild")
    return (
        read(spark, sf_dir, "orders")
        .crossJoin(F.broadcast(n))  # one row
        .select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % F.col("n")).alias("botanical_id"), severity.alias("severity"), F.col("o_orderstatus").alias("population"))
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))
    severity = F.when(F.col("value") >= 90, "severe").when(F.col("value") >= 40, "moderate").otherwise("mild")
    return (
        read(spark, sf_dir, "events")
        .crossJoin(F.broadcast(n))  # one row
        .select(F.col("event_id").alias("id"), (F.col("user_id") % F.col("n")).alias("botanical_id"), F.col("event_type").alias("drug_class"), severity.alias("interaction_severity"))
    )


#: The same tables in SQL, for the oracle.
SQL = {
    "botanicals": "SELECT s_suppkey AS id, s_name AS latin_binomial, n_name AS family FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "indications": "SELECT p_partkey AS id, p_name AS indication_text, lower(p_name) AS normalized_text, lower(p_type) AS category FROM part",
    "raw_edges": "SELECT l_partkey AS indication_id, l_suppkey AS botanical_id, l_quantity AS weight, CASE l_returnflag || l_linestatus "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEVELS.items())
    + " ELSE 'traditional' END AS evidence_level, '' AS preparation, l_orderkey AS source_ref, l_linenumber AS line FROM lineitem",
    "contraindications": "SELECT o_orderkey AS id, o_custkey % (SELECT count(*) FROM supplier) AS botanical_id, CASE left(o_orderpriority, 1) WHEN '1' THEN 'absolute' WHEN '2' THEN 'severe' WHEN '3' THEN 'moderate' ELSE 'mild' END AS severity, o_orderstatus AS population FROM orders",
    "interactions": "SELECT event_id AS id, user_id % (SELECT count(*) FROM supplier) AS botanical_id, event_type AS drug_class, CASE WHEN value >= 90 THEN 'severe' WHEN value >= 40 THEN 'moderate' ELSE 'mild' END AS interaction_severity FROM events",
}
SQL["edges"] = f"SELECT indication_id, botanical_id, preparation, weight, evidence_level, source_ref FROM (SELECT *, row_number() OVER (PARTITION BY indication_id, botanical_id, preparation ORDER BY source_ref DESC, line DESC, weight DESC, evidence_level DESC) AS rn FROM ({SQL['raw_edges']})) WHERE rn = 1"


def with_tables(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " "
