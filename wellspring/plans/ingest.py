"""Ingestion: folders of Markdown or text files, and volumes of monographs, into the store's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import monographs as M
from ..operators import chunks
from ..sources.store import Store

SUFFIXES = {"md": ["*.md", "*.markdown"], "txt": ["*.txt"]}


def read_files(spark: SparkSession, folder: str, kind: str = "md") -> DataFrame:
    """filename, filepath, content, doc_type: one row for each file of the folder itself."""
    if kind not in SUFFIXES:
        raise ValueError(f"no parser for files of kind {kind}")
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="{" + ",".join(SUFFIXES[kind]) + "}", recursiveFileLookup=False)
    return raw.select(
        F.col("_metadata.file_name").alias("filename"), F.col("_metadata.file_path").alias("filepath"), F.col("value").alias("content"), F.lit("markdown" if kind == "md" else "text").alias("doc_type")
    )


def parse(files: DataFrame, compat_headers: bool = False) -> DataFrame:
    """Adds title, binomials, indications (text, section, category) and safety (text, severity)."""
    t, md = F.col("content"), F.col("doc_type") == "markdown"
    plain = F.transform(E.text_indications(t), lambda x: F.struct(x.alias("text"), F.lit("heuristic_extraction").alias("section"), F.lit(None).cast("string").alias("category")))
    return files.select(
        "*",
        F.when(md, E.markdown_title(t)).otherwise(E.text_title(t)).alias("title"),
        E.document_binomials(t).alias("binomials"),
        F.when(md, E.markdown_indications(t, compat_headers)).otherwise(plain).alias("indications"),
        F.when(md, E.markdown_safety(t)).otherwise(F.array().cast("array<struct<text:string,severity:string>>")).alias("safety"),
    )


def document_edges(parsed: DataFrame) -> DataFrame:
    """filename, latin_binomial, indication_text: every name with every indication of its own document."""
    names = parsed.select("filename", F.explode("binomials").alias("latin_binomial"))
    items = parsed.select("filename", F.explode("indications").alias("i")).select("filename", F.col("i.text").alias("indication_text"), F.col("i.category").alias("category"))
    return names.join(items, "filename")


def ingest_documents(store: Store, folder: str, kind: str = "md", chunk_size: int = 500, overlap: int = 100) -> dict[str, int]:
    """Files with a known name are turned away and counted; the rest go to docs, chunks and the knowledge tables."""
    fresh, known = store.known_filenames(read_files(store.spark, folder, kind))
    fresh = parse(fresh).persist()
    store.write("docs", fresh.select("filename", "filepath", "content", "doc_type").withColumn("processed", F.lit(True)))
    ids = store.read("docs").select(F.col("id").alias("doc_id"), "filename")
    pieces = chunks.chunk(fresh.join(ids, "filename"), chunk_size, overlap, "doc_id", "content")
    store.write("chunks", pieces.withColumn("has_indications", F.lit(False)))
    edges = document_edges(fresh).persist()
    parts = F.split("latin_binomial", r"\s+")
    store.write("botanicals", fresh.select(F.explode("binomials").alias("latin_binomial")).distinct().withColumn("genus", F.get(parts, 0)).withColumn("species", F.get(parts, 1)))
    items = fresh.select(F.explode("indications").alias("i")).select(F.col("i.text").alias("indication_text"), F.col("i.text").alias("normalized_text"), F.col("i.category").alias("category"))
    store.write("indications", items.dropDuplicates(["normalized_text"]))
    link_edges(store, edges.withColumn("normalized_text", F.col("indication_text")).withColumn("evidence_level", F.lit("traditional")).withColumn("source_ref", F.col("filename")))
    out = {"documents": fresh.count(), "turned_away": known.count(), "edges": edges.count()}
    store.set_meta({"last_ingestion_source": folder, "total_botanicals": str(store.read("botanicals").count()), "total_indications": str(store.read("indications").count())})
    fresh.unpersist()
    edges.unpersist()
    return out


def link_edges(store: Store, edges: DataFrame) -> None:
    """Edges by names become edges by ids; unresolved ones drop out."""
    b = store.read("botanicals").select(F.col("id").alias("botanical_id"), "latin_binomial")
    i = store.read("indications").select(F.col("id").alias("indication_id"), "normalized_text")
    linked = edges.join(b, "latin_binomial").join(i, "normalized_text")
    linked = linked.groupBy("indication_id", "botanical_id").agg(F.max_by(F.struct("evidence_level", "source_ref"), "source_ref").alias("e"))
    store.write("edges", linked.select("indication_id", "botanical_id", F.lit(1.0).alias("weight"), "e.evidence_level", "e.source_ref", F.lit("").alias("preparation")))


def ingest_monographs(store: Store, folder: str) -> dict[str, int]:
    """Volumes named *Vol<n>*.txt."""
    raw = store.spark.read.text(folder, wholetext=True, pathGlobFilter="*Vol*.txt")
    volumes = raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"Vol(\d+)", 1).cast("int").alias("volume"), F.col("value").alias("content"))
    parsed = M.parse(M.split_volumes(volumes)).drop("content", "monograph").persist()
    store.write("botanicals", parsed.dropDuplicates(["latin_binomial"]).select("latin_binomial", F.slice("vernacular_names", 1, 10).alias("common_names"), "family", F.array("title").alias("parts_used")))
    edges = M.edges(parsed).persist()
    store.write("indications", edges.select("indication_text", "normalized_text", F.lit("therapeutic").alias("category")).dropDuplicates(["normalized_text"]))
    link_edges(store, edges)
    ids = store.read("botanicals").select(F.col("id").alias("botanical_id"), "latin_binomial")
    contra = parsed.select("latin_binomial", F.explode("contraindications").alias("contraindication")).join(ids, "latin_binomial")
    store.write("contraindications", contra.select("botanical_id", "contraindication", F.lit("moderate").alias("severity")))
    drugs = parsed.select("latin_binomial", F.explode("drug_interactions").alias("d")).join(ids, "latin_binomial")
    store.write("drug_interactions", drugs.select("botanical_id", F.array("d").alias("specific_drugs"), F.lit("unknown").alias("mechanism"), F.lit("moderate").alias("interaction_severity")))
    out = {"monographs": parsed.count(), "edges": edges.count()}
    parsed.unpersist()
    edges.unpersist()
    return out
