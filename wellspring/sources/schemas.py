"""Schemas of the knowledge-base tables."""

SCHEMAS = {
    "botanicals": "id long, latin_binomial string, common_names array<string>, family string, genus string, species string, parts_used array<string>, energetics map<string,string>, traditional_systems array<string>, created_at timestamp_ntz, updated_at timestamp_ntz",
    "indications": "id long, indication_text string, normalized_text string, category string, subcategory string, body_system string, created_at timestamp_ntz",
    "edges": "id long, indication_id long, botanical_id long, weight double, evidence_level string, source_ref string, preparation string, dosage_notes string, created_at timestamp_ntz",
    "contraindications": "id long, botanical_id long, contraindication string, severity string, population string, mechanism string, source_ref string",
    "drug_interactions": "id long, botanical_id long, drug_class string, specific_drugs array<string>, interaction_severity string, mechanism string, recommendation string",
    "docs": "id long, filename string, filepath string, content string, source string, doc_type string, author string, year int, ingested_at timestamp_ntz, processed boolean",
    "chunks": "id long, doc_id long, chunk_text string, start_pos int, end_pos int, chunk_index int, has_indications boolean",
    "chunk_indications": "id long, chunk_id long, extracted_text string, confidence double, matched_indication_id long",
    "meta": "key string, value string, updated_at timestamp_ntz",
}
META_SEED = {"schema_version": "1", "lexical_index_built": "false", "vector_index_built": "false", "total_botanicals": "0", "total_indications": "0"}
