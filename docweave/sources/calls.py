"""Recorded model calls: files of request and response as a calls table and as answers to replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = (
    "struct<source_tables: array<string>, source_fields: array<string>, destination_collections: array<string>, destination_paths: array<string>, detail_level: string>"
)
_ENTRY = "struct<source_field: string, destination_field: string, confidence: double, reasoning: string, notes: string>"
RECORD = (
    f"request struct<stage: string, model_id: string, system: string, user: string, manifest: {_MANIFEST}>, "
    f"response struct<data: struct<mappings: array<{_ENTRY}>, destination_field: string, destination_collection: string, confidence: double, reasoning: string, notes: string>, "
    "input_tokens: long, output_tokens: long, model_id: string, latency_ms: long>"
)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per recorded call."""
    return spark.read.schema(RECORD).json(folder, multiLine=True)


def calls_of(records: DataFrame) -> DataFrame:
    """Records as CALLS rows, in order of stage and fields."""
    m: Column = F.col("request.manifest")
    rows = records.select(
        F.col("request.stage").alias("stage"), F.col("request.model_id").alias("model_id"), "response.input_tokens", "response.output_tokens", "response.latency_ms",
        F.lit(False).alias("cache_hit"), m["source_tables"].alias("source_tables"), m["source_fields"].alias("source_fields"),
        m["destination_collections"].alias("destination_collections"), m["destination_paths"].alias("destination_paths"),
        F.coalesce(m["detail_level"], F.lit("typed")).alias("detail_level"), (F.length("request.system") + F.length("request.user")).cast("long").alias("prompt_chars"),
        F.coalesce(F.size("response.data.mappings"), F.lit(0)).alias("mappings"),
    )
    return rows.withColumn("seq", F.monotonically_increasing_id())


def answers_of(records: DataFrame, strong_model: str | None = None) -> DataFrame:
    """Records as replayable answers: stage, table and ANSWERS columns. Calls of the strong model are stage escalate."""
    table = F.substring_index(F.get("request.manifest.source_fields", F.lit(0)), ".", 1)
    stage = F.when((F.col("request.stage") == "adjudicate") & (F.col("request.model_id") == F.lit(strong_model)), "escalate").otherwise(F.col("request.stage"))
    many = records.filter("request.stage = 'adjudicate'").select(stage.alias("stage"), table.alias("table"), F.col("response.model_id").alias("model"), F.explode("response.data.mappings").alias("e"))
    many = many.select("stage", "table", F.col("e.source_field").alias("name"), F.col("e.destination_field").alias("path"), "e.confidence", "e.reasoning", "e.notes", "model")
    d = F.col("response.data")
    name = F.substring_index(F.get("request.manifest.source_fields", F.lit(0)), ".", -1)
    one = records.filter("request.stage = 'reflect'").select(
        F.lit("reflect").alias("stage"), table.alias("table"), name.alias("name"), d["destination_field"].alias("path"), d["confidence"].alias("confidence"),
        d["reasoning"].alias("reasoning"), d["notes"].alias("notes"), F.col("response.model_id").alias("model"),
    )
    return many.unionByName(one)


def routes_of(records: DataFrame) -> list[tuple[str, str, float, str]]:
    """Recorded routing proposals, a row per table."""
    d = F.col("response.data")
    rows = records.filter("request.stage = 'route'").select(
        F.get("request.manifest.source_tables", F.lit(0)).alias("t"), d["destination_collection"].alias("c"), d["confidence"].alias("p"), d["reasoning"].alias("r")
    )
    return [tuple(r) for r in rows.collect()]
