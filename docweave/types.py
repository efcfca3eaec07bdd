"""Schemas, type categories and thresholds that the whole library shares."""

from __future__ import annotations

from dataclasses import dataclass

SOURCE_FIELDS = (
    "database string, dialect string, table string, table_ord int, ord int, name string, sql_type string, base_type string, "
    "nullable boolean, is_pk boolean, is_fk boolean, is_unique boolean, references string, comment string"
)
DEST_FIELDS = (
    "database string, dialect string, collection string, coll_ord int, ord int, path string, bson_type string, comment string, references string"
)
PASS = "struct<pass: string, model: string, destination_field: string, confidence: double, reasoning: string>"
DECISIONS = (
    "table string, table_ord int, ord int, name string, collection string, path string, model_confidence double, confidence double, "
    f"reasoning string, notes string, decided_by string, passes array<{PASS}>, repaired boolean, tie_broken boolean, forced_null string"
)
ANSWERS = "table string, name string, path string, confidence double, reasoning string, notes string, model string"
CALLS = (
    "seq long, stage string, model_id string, input_tokens long, output_tokens long, latency_ms long, cache_hit boolean, "
    "source_tables array<string>, source_fields array<string>, destination_collections array<string>, destination_paths array<string>, "
    "detail_level string, prompt_chars long, mappings int"
)
DIAGNOSTICS = "kind string, key string, detail string"
FIELD_MAPPING = "struct<source_field: string, destination_field: string, type_transform: string, confidence: double, reasoning: string, notes: string>"
MAPPING_DOCUMENT = (
    "mapping_version string, source string, destination string, generated_at string, "
    "tables array<struct<source_table: string, destination_collection: string, confidence: double, reasoning: string, "
    f"field_mappings: array<{FIELD_MAPPING}>, unmapped_source_fields: array<string>, unmapped_destination_fields: array<string>>>"
)
#: Kinds of diagnostics after which a document can't be used.
FATAL = ("schema_violation", "coverage_error", "unresolved_path")

# Category of each base type, on either side.
SQL_CATEGORIES = {
    "INT": "integer", "INTEGER": "integer", "BIGINT": "integer", "SMALLINT": "integer", "MEDIUMINT": "integer", "TINYINT": "integer", "YEAR": "integer",
    "BOOL": "boolean", "BOOLEAN": "boolean",
    "DECIMAL": "decimal", "NUMERIC": "decimal", "FLOAT": "decimal", "DOUBLE": "decimal",
    "VARCHAR": "string", "CHAR": "string", "TEXT": "string", "TINYTEXT": "string", "MEDIUMTEXT": "string", "LONGTEXT": "string", "ENUM": "string", "TIME": "string",
    "DATE": "date", "DATETIME": "datetime", "TIMESTAMP": "datetime", "JSON": "object", "BLOB": "binary",
}
BSON_CATEGORIES = {
    "OBJECTID": "objectid", "STRING": "string", "NUMBER": "number", "INT32": "number", "INT64": "number", "DOUBLE": "number", "DECIMAL128": "number",
    "ISODATE": "datetime", "DATE": "datetime", "TIMESTAMP": "datetime", "BOOLEAN": "boolean", "BOOL": "boolean", "OBJECT": "object", "ARRAY": "array",
}
# How well a source category suits a destination category; any other pair has TYPE_DEFAULT.
TYPE_MATRIX = {
    "integer": {"number": 1.0, "objectid": 0.75, "string": 0.30, "boolean": 0.25},
    "decimal": {"number": 1.0, "string": 0.25},
    "string": {"string": 1.0, "objectid": 0.30, "number": 0.20, "boolean": 0.25, "datetime": 0.20},
    "date": {"datetime": 1.0, "string": 0.40},
    "datetime": {"datetime": 1.0, "string": 0.40, "number": 0.20},
    "boolean": {"boolean": 1.0, "number": 0.40, "string": 0.30},
    "object": {"object": 1.0},
    "binary": {"string": 0.30},
}
TYPE_DEFAULT = 0.15
#: Base types whose arguments belong to their label.
KEEP_ARGS = ("CHAR", "TINYINT", "DECIMAL", "NUMERIC", "FLOAT", "DOUBLE", "BIT")


@dataclass(frozen=True)
class Thresholds:
    """Every number that a run depends on."""

    high: float = 0.90
    medium: float = 0.80
    escalate_below: float = 0.80
    reflect_below: float = 0.75
    collision_delta: float = 0.05
    top_k: int = 6
    floor: float = 0.15
    batch: int = 8
    model_weight: float = 0.60
    retrieval_weight: float = 0.40
    type_penalty: float = 0.05
    manual_cap: float = 0.85
    token_ceiling: int = 120_000


DEFAULTS = Thresholds()


class SchemaError(ValueError):
    """Input that can't be read as a schema; the message says what to change."""
