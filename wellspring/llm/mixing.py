"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token totals by (source, language, topic) cell are raked: each sweep scales the cells' weights so that the weighted
tokens of every source, then language, then topic meet their targets, and no weight exceeds 1. A document is sampled
if a uniform number derived from its id is below the calibrated weight of its cell, so a sample repeats exactly and does not
depend on partitions.

Plan. Documents are aggregated to cells with map-side combination (a hot source costs one row for each task). The sweeps
run on cells alone: in one task while the cells are at most `single_task_cells`, else as ordinary windows that shuffle. The cells go back to the documents by a
broadcast behind a count, else by a join.

Defined cases: null source, language or topic is a category "(none)"; null text has no tokens; categories without a
target keep a target equal to their own share; ids that are null or repeated get one number for each id, so equal rows are sampled alike; an empty
table gives an empty result; extra columns pass through `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, materialise, maybe_broadcast

DIMS = ("source", "lang", "topic")


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A topic by rule, from the text alone."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.contains("icense") | t.contains("rights reserved"), "licence")
        .when(t.contains("@"), "contact")
        .when(t.contains("|"), "table")
        .otherwise("prose")
    )


def uniform(ident: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 32 bits of a digest of the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def targets(cells: DataFrame, powers: dict[str, float], budget: float) -> DataFrame:
    """cells: the DIMS and tokens. Target of a category: its token share to a power, over the sum of those. Adds the goal and a first weight."""
    for d in DIMS:
        totals = cells.groupBy(d).agg(F.sum("tokens").alias("category_tokens"))
        share = F.col("category_tokens") / F.sum("category_tokens").over(Window.partitionBy())
        raised = F.when(share > 0, F.pow(share, F.lit(powers.get(d, 1.0)))).otherwise(0.0)
        totals = totals.withColumn("raised", raised).withColumn(f"{d}_target", F.col("raised") / F.sum("raised").over(Window.partitionBy()))
        cells = cells.join(totals.select(d, f"{d}_target"), d)
    goal = F.sum("tokens").over(Window.partitionBy()) * budget
    return cells.withColumn("goal", goal).withColumn("weight", F.lit(budget))


def rake(cells: DataFrame, sweeps: int) -> DataFrame:
    """Sweeps of iterative proportional fitting over the DIMS; weights stay at most 1."""
    for _ in range(sweeps):
        for d in DIMS:
            now = F.sum(F.col("weight") * F.col("tokens")).over(Window.partitionBy(d))
            cells = cells.withColumn("weight", F.when(now > 0, F.least(F.lit(1.0), F.col("weight") * F.col(f"{d}_target") * F.col("goal") / now)).otherwise(F.col("weight")))
    return cells


def mixed(
    docs: DataFrame, powers: dict[str, float], budget: float = 0.5, sweeps: int = 8, seed: int = 17, single_task_cells: int = 200_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: row (the input as a struct), id, source, lang, topic, n_tokens, weight, selected."""
    none = lambda c: F.coalesce(c.cast("string"), F.lit("(none)"))
    base = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs[id_col].alias("id"),
        none(docs["source"]).alias("source"),
        none(docs["lang"]).alias("lang"),
        topic_of(docs[text_col]).alias("topic"),
        token_count(docs[text_col]).alias("n_tokens"),
    )
    cells = materialise(base.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "mixing-cells")
    n = cells.count()
    placed = lambda df: df.coalesce(1) if n <= single_task_cells else df
    start = materialise(targets(placed(cells), powers, budget), "mixing-targets")
    weights = materialise(rake(placed(start), sweeps).select(*DIMS, "weight"), "mixing-weights")
    out = base.join(maybe_broadcast(weights, rows=n), list(DIMS))
    return out.withColumn("selected", uniform(F.col("id"), seed) < F.col("weight"))


#: Flatter than the corpus: sources most, topics least.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}


def mix(docs: DataFrame, powers: dict[str, float] = POWERS, **params) -> DataFrame:
    """The sampled documents, with the input's columns."""
    return mixed(docs, powers, **params).filter("selected").select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixed(documents(spark, sf_dir), POWERS)
    return got.select(F.col("id").alias("doc_id"), "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), "selected")


def oracle(powers: dict[str, float] = POWERS, budget: float = 0.5, sweeps: int = 8, seed: int = 17) -> str:
    out = [
        r"""WITH base AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
 CASE WHEN contains(coalesce(text, ''), 'icense') OR contains(coalesce(text, ''), 'rights reserved') THEN 'licence'
 WHEN contains(coalesce(text, ''), '@') THEN 'contact' WHEN contains(coalesce(text, ''), '|') THEN 'table' ELSE 'prose' END AS topic,
 coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents)""",
        "cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM base GROUP BY ALL)",
    ]
    for d in DIMS:
        out.append(f"t_{d} AS (SELECT {d}, sum(tokens) / (SELECT sum(tokens) FROM cells) AS share FROM cells GROUP BY {d})")
        out.append(f"p_{d} AS (SELECT {d}, CASE WHEN share > 0 THEN pow(share, {powers.get(d, 1.0)}) ELSE 0 END AS raised FROM t_{d})")
        out.append(f"g_{d} AS (SELECT {d}, raised / (SELECT sum(raised) FROM p_{d}) AS {d}_target FROM p_{d})")
    out.append(
        f"s0 AS MATERIALIZED (SELECT c.*, {', '.join(f'{d}_target' for d in DIMS)}, (SELECT sum(tokens) FROM cells) * {budget} AS goal, {budget}::DOUBLE AS weight FROM cells c "
        + " ".join(f"JOIN g_{d} USING ({d})" for d in DIMS)
        + ")"
    )
    k = 0
    for _ in range(sweeps):
        for d in DIMS:
            now = f"sum(weight * tokens) OVER (PARTITION BY {d})"
            out.append(
                f"s{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, {', '.join(f'{x}_target' for x in DIMS)}, goal, CASE WHEN {now} > 0 THEN least(1.0, weight * {d}_target * goal / {now}) ELSE weight END AS weight FROM s{k})"
            )
            k += 1
    return ",\n".join(out) + (
        f"\nSELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight,"
        f" ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0 < weight AS selected FROM base JOIN s{k} USING (source, lang, topic)"
    )
