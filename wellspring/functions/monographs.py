"""Volumes of monographs: splitting and section fields, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extract import sentences

# Section headings in their order.
HEADINGS = ["Definition", "Synonyms", "Selected vernacular names", "Description", "Medicinal uses", "Pharmacology", "Clinical pharmacology", "Contraindications", "Warnings", "Precautions", "Adverse reactions", "Posology"]
CLINICAL, PHARMACOPOEIA, FOLK = "Uses supported by clinical data", "Uses described in pharmacopoeias", "Uses described in folk medicine"
LATIN = r"\bof\s+([A-Z][a-z]+\s+[a-z]+(?:\s+(?:L\.|\(L\.\)\s+[A-Za-z]+\.?|J\.S\.\s+Presl\.|\(Fisch\.\)\s+Bunge|\(L\.\)\s+Rauschert|\(L\.\)\s+Urb\.))?)"
HEADER = r"\n([A-Z][a-zA-Z\s]+(?:[A-Z][a-z]+)?)\n\nDefinition\n"


def split_volumes(volumes: DataFrame, text: str = "content") -> DataFrame:
    """One row for each monograph; a look-ahead split keeps the title with its text."""
    t = F.regexp_replace(F.regexp_replace(F.col(text), "\f", "\n"), "ﬁ", "fi")
    t = F.regexp_replace(t, r"(?s)\A.*?Introduction\n.*?\n\d+\n", "")
    parts = F.split(t, rf"(?={HEADER})")
    return volumes.withColumn("monograph", F.explode(F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.rlike(x, F.lit(r"\A[A-Z][a-zA-Z\s]+\n\nDefinition\n")))))


def section(text: Column, name: str, until: list[str]) -> Column:
    """The text after a heading, up to the first of the headings that may follow."""
    ahead = "|".join([*[rf"\n{u}" for u in until], r"\z"])
    return F.regexp_replace(F.regexp_extract(text, rf"(?s){name}\n(.*?)(?={ahead})", 1), r"^\s+|\s+$", "")


def uses(text: Column, lead: str, until: list[str]) -> Column:
    return F.regexp_replace(F.regexp_extract(text, rf"(?s){lead}\s+(.*?)(?={'|'.join([*until, chr(92) + 'z'])})", 1), r"^\s+|\s+$", "")


def parse(monographs: DataFrame, text: str = "monograph") -> DataFrame:
    t = F.col(text)
    definition = section(t, "Definition", ["Synonyms", "Description", "Medicinal uses", "Pharmacology"])
    synonyms = section(t, "Synonyms", ["Selected vernacular names", "Description", "Medicinal uses"])
    names = section(t, "Selected vernacular names", ["Description", "Medicinal uses"])
    medicinal = section(t, "Medicinal uses", ["Pharmacology", "Clinical pharmacology", "Contraindications", "Warnings", "Precautions", "Adverse reactions", "Posology"])
    precautions = section(t, "Precautions", ["Adverse reactions", "Posology"])
    items = lambda x, pattern, least: F.filter(F.transform(F.split(x, pattern), lambda s: F.trim(s)), lambda s: F.length(s) > least)
    latin = F.regexp_extract_all(definition, F.lit(LATIN), 1)
    return monographs.select(
        "*",
        F.trim(F.substring_index(t, "\n", 1)).alias("title"),
        F.when(F.size(latin) > 0, F.element_at(latin, -1)).alias("latin_binomial"),
        F.nullif(F.regexp_extract(definition, r"\(([A-Za-z]+aceae)\)", 1), F.lit("")).alias("family"),
        items(synonyms, r"[,;]|\(\d+\)", 2).alias("synonyms"),
        items(names, r"[,;]", 1).alias("vernacular_names"),
        sentences(uses(medicinal, CLINICAL, [PHARMACOPOEIA, FOLK, rf"\n{CLINICAL}"])).alias("indications_clinical"),
        sentences(uses(medicinal, rf"{PHARMACOPOEIA} and[\s\S]*?in traditional systems of[\s\S]*?medicine", [FOLK, CLINICAL])).alias("indications_traditional"),
        sentences(uses(medicinal, rf"{FOLK}, not supported by[\s\S]*?clinical data", [PHARMACOPOEIA, CLINICAL, r"\nClinical pharmacology"])).alias("indications_folk"),
        sentences(section(t, "Contraindications", ["Warnings", "Precautions", "Adverse reactions", "Posology"])).alias("contraindications"),
        sentences(section(t, "Warnings", ["Precautions", "Adverse reactions", "Posology"])).alias("warnings"),
        sentences(precautions).alias("precautions"),
        F.transform(F.filter(F.split(precautions, "\n"), lambda x: F.contains(F.lower(x), F.lit("interaction"))), lambda x: F.trim(x)).alias("drug_interactions"),
        sentences(section(t, "Adverse reactions", ["Posology"])).alias("adverse_reactions"),
        F.substring(section(t, "Posology", []), 1, 500).alias("posology"),
    ).filter((F.length("title") >= 3) & F.col("latin_binomial").isNotNull())


def edges(parsed: DataFrame, volume: str = "volume") -> DataFrame:
    """latin_binomial, indication_text, normalized_text, evidence_level, source_ref: joined on the normalized text."""
    level = lambda name, column: F.struct(F.lit(name).alias("evidence_level"), F.col(column).alias("texts"))
    sets = F.explode(F.array(level("clinical_trial", "indications_clinical"), level("traditional", "indications_traditional"), level("ethnobotanical", "indications_folk"))).alias("s")
    flat = parsed.select("latin_binomial", volume, sets).select("latin_binomial", volume, "s.evidence_level", F.explode("s.texts").alias("indication_text"))
    return flat.select(
        "latin_binomial", "indication_text", F.trim(F.lower("indication_text")).alias("normalized_text"), "evidence_level", F.concat(F.lit("Monographs Vol"), F.col(volume).cast("string")).alias("source_ref")
    )
