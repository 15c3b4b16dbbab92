"""The ten tables of the store (A9) as explicit Spark schemas (DDL text), their keys and references."""

from __future__ import annotations

from dataclasses import dataclass


SOURCES = "array<struct<document_name:string,page_number:int,score:double,text:string>>"

TABLES: dict[str, str] = {
    "fields": (
        "field_id BIGINT, public_id STRING, geometry ARRAY<ARRAY<ARRAY<DOUBLE>>>, geometry_hash STRING, area_hectares DOUBLE, "
        "crop_name STRING, planted_on DATE, growth_stage STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
    ),
    "acquisitions": (
        "acquisition_id BIGINT, field_id BIGINT, acquired_at TIMESTAMP, product_id STRING, revision_key STRING, cloud_coverage DOUBLE, "
        "processed_at TIMESTAMP, source_metadata MAP<STRING,STRING>, valid_pixel_count BIGINT, fully_cloudy BOOLEAN, "
        "processing_error STRING, created_at TIMESTAMP"
    ),
    "index_values": (
        "acquisition_id BIGINT, index_name STRING, relative_path STRING, valid_pixel_count BIGINT, mean_value DOUBLE, "
        "min_value DOUBLE, median_value DOUBLE, max_value DOUBLE"
    ),
    "artifacts": (
        "artifact_id BIGINT, acquisition_id BIGINT, layer_name STRING, bbox ARRAY<DOUBLE>, width INT, height INT, "
        "render_version STRING, relative_path STRING, created_at TIMESTAMP"
    ),
    "recommendations": (
        "field_id BIGINT, acquisition_id BIGINT, content STRING, advice STRUCT<red:ARRAY<STRING>,yellow:ARRAY<STRING>,green:ARRAY<STRING>>, "
        "model_name STRING, created_at TIMESTAMP"
    ),
    "chat_messages": (
        f"message_id BIGINT, field_id BIGINT, role STRING, content STRING, rag_sources {SOURCES}, rag_strategy STRING, "
        "rag_source_title STRING, created_at TIMESTAMP"
    ),
    "chat_summaries": (
        "field_id BIGINT, summary_text STRING, message_count BIGINT, last_message_id BIGINT, updated_at TIMESTAMP"
    ),
    "documents": (
        "document_id BIGINT, name STRING, file_path STRING, file_hash STRING, total_pages INT, chunk_count BIGINT, "
        "embedding_model STRING, embedding_dim INT, is_active BOOLEAN, created_at TIMESTAMP"
    ),
    "chunks": (
        "chunk_id BIGINT, document_id BIGINT, page_number INT, chunk_index INT, chunk_text STRING, embedding ARRAY<FLOAT>"
    ),
    "yield_predictions": (
        "prediction_id BIGINT, field_id BIGINT, crop STRING, model_name STRING, predicted_yield_t_ha DOUBLE, yield_min_expected DOUBLE, "
        "yield_max_expected DOUBLE, total_expected_yield_tons DOUBLE, field_area_ha DOUBLE, "
        "top_features ARRAY<STRUCT<feature:STRING,importance:DOUBLE,description:STRING>>, "
        "phenology_timeline ARRAY<STRUCT<month:INT,ndvi:DOUBLE,evi:DOUBLE,ndre:DOUBLE,ndmi:DOUBLE,s1_vh:DOUBLE,s1_vv_vh:DOUBLE,"
        "temp_mean:DOUBLE,rain_sum:DOUBLE,soil_moisture:DOUBLE>>, created_at TIMESTAMP"
    ),
}

UNIQUE_KEYS: dict[str, list[list[str]]] = {
    "fields": [["field_id"], ["public_id"], ["geometry_hash"]],
    "acquisitions": [["acquisition_id"], ["field_id", "product_id", "revision_key"]],
    "index_values": [["acquisition_id", "index_name"], ["relative_path"]],
    "artifacts": [["artifact_id"], ["relative_path"], ["acquisition_id", "layer_name", "render_version"]],
    "recommendations": [["field_id"]],
    "chat_messages": [["message_id"]],
    "chat_summaries": [["field_id"]],
    "documents": [["document_id"]],
    "chunks": [["chunk_id"]],
    "yield_predictions": [["prediction_id"]],
}


@dataclass(frozen=True)
class Reference:
    child: str
    column: str
    parent: str


REFERENCES = (
    Reference("acquisitions", "field_id", "fields"),
    Reference("index_values", "acquisition_id", "acquisitions"),
    Reference("artifacts", "acquisition_id", "acquisitions"),
    Reference("recommendations", "field_id", "fields"),
    Reference("recommendations", "acquisition_id", "acquisitions"),
    Reference("chat_messages", "field_id", "fields"),
    Reference("chat_summaries", "field_id", "fields"),
    Reference("chunks", "document_id", "documents"),
    Reference("yield_predictions", "field_id", "fields"),
)
