"""Declared schemas of the engine's tables."""

from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_TYPES = {
    "STRING": StringType(),
    "INT": IntegerType(),
    "LONG": LongType(),
    "BOOLEAN": BooleanType(),
    "TIMESTAMP": TimestampType(),
}


def _schema(columns: str) -> StructType:
    """Columns as ``name TYPE`` pairs; needs no session, unlike DDL parsing."""
    pairs = (column.split() for column in columns.split(","))
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


STAGED_SOURCES = _schema(
    "world_id STRING, staging_entry_id STRING, source_order LONG, source_path STRING, "
    "source_file_type STRING, is_valid BOOLEAN, error_message STRING"
)
PARSED_SOURCES = _schema(
    "world_id STRING, attempt_id STRING, staging_entry_id STRING, source_order LONG, "
    "source_file_type STRING, parsed_text STRING"
)
SPLIT_CHUNKS = _schema(
    "world_id STRING, attempt_id STRING, staging_entry_id STRING, source_order LONG, "
    "source_file_type STRING, chunk_number INT, chunk_text STRING, overlap_text STRING, "
    "character_start_offset INT, character_end_offset INT, splitter_version STRING"
)
SOURCES = _schema(
    "world_id STRING, source_id STRING, original_filename STRING, stored_path STRING, "
    "source_file_type STRING, source_hash STRING, book_number LONG, committed_at TIMESTAMP"
)
CHUNKS = _schema(
    "world_id STRING, chunk_id STRING, source_id STRING, book_number LONG, chunk_number INT, "
    "chunk_text STRING, overlap_text STRING, character_start_offset INT, character_end_offset INT"
)
WORLDS = _schema(
    "world_id STRING, display_name STRING, display_name_key STRING, description STRING, "
    "background_asset_id STRING, font_asset_id STRING, last_used_at TIMESTAMP"
)
SPLITTER_SETTINGS = _schema(
    "world_id STRING, chunk_size INT, max_lookback_size INT, overlap_size INT, "
    "splitter_version STRING, is_locked BOOLEAN"
)
ASSETS = _schema(
    "asset_id STRING, asset_type STRING, display_name STRING, stored_path STRING, "
    "file_hash STRING, is_built_in BOOLEAN, full_font_name STRING, original_filename STRING"
)
VIOLATIONS = _schema(
    "world_id STRING, entity STRING, entity_key STRING, rule STRING, message STRING"
)
