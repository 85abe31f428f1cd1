"""Search and ranking plans. Queries and cases are tables, so a batch is one plan and never a loop on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import evidence_multiplier
from ..operators import fusion, lexical, vector
from ..operators.relational import safety_profiles

MODES = ("lexical", "vector", "hybrid")
DEPTH = 50


@dataclass
class Engine:
    """The tables of a knowledge base and its indexes; vectors are optional."""

    spark: SparkSession
    botanicals: DataFrame
    indications: DataFrame
    edges: DataFrame
    index: lexical.LexicalIndex
    contraindications: DataFrame | None = None
    interactions: DataFrame | None = None
    vectors: DataFrame | None = None
    analysis: lexical.Analysis | None = None
    fusion_method: str = "rrf"

    def queries(self, texts: list[str]) -> DataFrame:
        return lexical.query_table(self.spark, texts)

    def search(self, queries: DataFrame, mode: str = "hybrid", limit: int = 20, category: str | None = None, digits: int | None = None, **params) -> DataFrame:
        """query_id, id, score, rank, match_type."""
        if mode not in MODES:
            raise ValueError(f"unknown search mode {mode}")
        columns = ["query_id", "id", "score", "rank", "match_type"]
        if mode == "lexical" or self.vectors is None:
            return lexical.search(self.index, queries, self.indications, limit, category, analysis=self.analysis, digits=digits, **params).select(*columns)
        embedded = vector.embed(queries.withColumnRenamed("query_id", "id"), "query").withColumnRenamed("id", "query_id")
        deep = DEPTH if mode == "hybrid" else limit
        by_vector = vector.top_k(self.vectors, embedded, deep, digits=digits)
        if mode == "vector":
            return by_vector.withColumn("match_type", F.lit("vector")).select(*columns)
        by_words = lexical.search(self.index, queries, self.indications, DEPTH, category, analysis=self.analysis, digits=digits, **params)
        return fusion.fuse(by_words, by_vector, self.fusion_method, limit=limit, digits=digits).select(*columns)

    def repertorize(
        self, symptoms: list[str] | str, top_n: int = 20, mode: str = "hybrid", rubrics_per_symptom: int = 10, include_safety: bool = True, evidence_weight: bool = True
    ) -> DataFrame:
        """Ranked remedies for one case: a list of symptoms, or one string with commas."""
        parts = [s.strip() for s in symptoms.split(",")] if isinstance(symptoms, str) else symptoms
        cases = self.spark.createDataFrame([(0, i, s) for i, s in enumerate(parts)], "case_id long, ord int, symptom string")
        return self.repertorize_batch(cases, top_n, mode, rubrics_per_symptom, include_safety, evidence_weight)

    def repertorize_batch(self, cases: DataFrame, top_n: int = 20, mode: str = "hybrid", rubrics_per_symptom: int = 10, include_safety: bool = True, evidence_weight: bool = True) -> DataFrame:
        """cases: case_id, ord, symptom. One row for each case and remedy: rank, total_score, matches, safety."""
        keyed = cases.withColumn("query_id", F.xxhash64("case_id", "ord"))
        hits = self.search(keyed.select("query_id", F.col("symptom").alias("query")), mode, rubrics_per_symptom)
        scored = contributions(hits.join(keyed, "query_id"), self.edges, evidence_weight)
        named = scored.join(self.indications.select(F.col("id").alias("indication_id"), "indication_text"), "indication_id")
        ranked = rank_remedies(named, top_n, matches=True)
        b = self.botanicals.withColumnRenamed("id", "botanical_id")
        out = ranked.join(b, "botanical_id")
        if include_safety and self.contraindications is not None:
            # Only the remedies that made the cut need a profile.
            few = b.join(ranked.select("botanical_id").distinct(), "botanical_id", "left_semi").withColumnRenamed("botanical_id", "id")
            safety = safety_profiles(few, self.contraindications, self.interactions).drop("latin_binomial")
            out = out.join(safety, "botanical_id", "left")
        return out


def contributions(hits: DataFrame, edges: DataFrame, evidence_weight: bool = True) -> DataFrame:
    """Each hit's edges with score = weight x evidence multiplier x (0.5 + 0.5 x retrieval score)."""
    h = hits.withColumnRenamed("id", "indication_id").withColumnRenamed("score", "retrieval_score").withColumnRenamed("rank", "hit_rank")
    one = F.col("weight") * (evidence_multiplier(F.col("evidence_level")) if evidence_weight else F.lit(1.0))
    return h.join(edges, "indication_id").withColumn("score", one * (F.lit(0.5) + F.lit(0.5) * F.col("retrieval_score")))


def rank_remedies(scored: DataFrame, top_n: int, matches: bool = False, digits: int | None = None) -> DataFrame:
    """Sum by case and remedy, then rank 1..top_n; ties go to the remedy met first."""
    total = F.round(F.sum("score"), digits) if digits is not None else F.sum("score")
    first = F.min(F.struct("ord", "hit_rank", -F.col("weight"), "botanical_id"))
    aggs = [total.alias("total_score"), F.count(F.lit(1)).alias("n_matches"), first.alias("first")]
    if matches:
        fields = ["ord", "hit_rank", F.negative("weight").alias("down"), "symptom", F.col("indication_text").alias("indication"), "indication_id", "evidence_level", "weight", F.col("score").alias("score_contribution"), "preparation", "retrieval_score", "match_type"]
        aggs.append(F.array_sort(F.collect_list(F.struct(*fields))).alias("matches"))
    by = scored.groupBy("case_id", "botanical_id").agg(*aggs)
    order = Window.partitionBy("case_id").orderBy(F.desc("total_score"), "first")
    return by.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n).drop("first")


def csv_rows(ranked: DataFrame) -> DataFrame:
    """The nine columns of the CSV export."""
    levels = F.transform("matches", lambda m: F.struct(evidence_multiplier(m["evidence_level"]).alias("x"), m["evidence_level"].alias("level")))
    names = F.coalesce(F.array_join(F.slice("common_names", 1, 3), "; "), F.lit("")) if "common_names" in ranked.columns else F.lit("")
    return ranked.select(
        F.col("rank").alias("Rank"),
        F.col("latin_binomial").alias("Latin Binomial"),
        names.alias("Common Names"),
        F.coalesce("family", F.lit("")).alias("Family"),
        F.format_string("%.2f", "total_score").alias("Score"),
        F.size("matches").alias("Matches"),
        F.coalesce(F.array_max(levels)["level"], F.lit("unknown")).alias("Evidence"),
        (F.when(F.col("critical"), "Yes").otherwise("No") if "critical" in ranked.columns else F.lit("No")).alias("Safety Warning"),
        F.array_join(F.slice(F.array_distinct(F.transform("matches", lambda m: m["indication"])), 1, 5), "; ").alias("Key Indications"),
    )


def export_json(ranked: DataFrame, path: str | None = None) -> str:
    """One document for a ranked list; its size is bounded by top_n."""
    import datetime
    import json

    rows = [json.loads(r[0]) for r in ranked.orderBy("rank").select(F.to_json(F.struct("*"))).collect()]
    out = json.dumps({"export_date": datetime.datetime.now().isoformat(), "total_results": len(rows), "results": rows}, indent=2)
    if path:
        with open(path, "w") as f:
            f.write(out)
    return out


def export_csv(ranked: DataFrame, path: str) -> None:
    csv_rows(ranked).orderBy("Rank").write.mode("overwrite").csv(path, header=True)


def export_markdown(ranked: DataFrame, symptoms: list[str]) -> str:
    out = ["# Ranked remedies", "", f"Symptoms: {', '.join(symptoms)}", ""]
    for r in csv_rows(ranked).orderBy("Rank").collect():
        out += [f"## {r['Rank']}. {r['Latin Binomial']}", "", f"- Family: {r['Family']}", f"- Score: {r['Score']}", f"- Matches: {r['Matches']} ({r['Key Indications']})", f"- Evidence: {r['Evidence']}", f"- Critical warnings: {r['Safety Warning']}", ""]
    return "\n".join(out)


def format_text(ranked: DataFrame) -> str:
    return "\n".join(f"{r['Rank']:>3}. {r['Latin Binomial']}  {r['Score']}  [{r['Evidence']}]  {r['Key Indications']}" for r in csv_rows(ranked).orderBy("Rank").collect())
