"""The library's surface: what a service or a notebook calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import pairing
from docweave.operators.ledger import PRICES, model_prices
from docweave.operators.migrate import migrate, preview
from docweave.operators.shortlist import shortlist
from docweave.plans.run import Run, compile_mapping, map_schemas
from docweave.sinks.writers import HISTORY, list_runs, persist_run
from docweave.sources import reader
from docweave.types import DEFAULTS, MAPPING_DOCUMENT

__all__ = ["candidates", "contract_schema", "describe", "migrate", "migrate_table", "model_prices", "parse", "persist_run", "preview", "run", "runs"]


def describe(spark: SparkSession) -> dict:
    return {"status": "ok", "spark": spark.version, "models": len(PRICES), "limits": DEFAULTS.__dict__}


def contract_schema() -> str:
    """The mapping document's columns as DDL."""
    return MAPPING_DOCUMENT


def parse(spark: SparkSession, source_text: str, dest_text: str, names: tuple[str, str] = ("", "")) -> dict[str, DataFrame]:
    """Fields of both schemas and whether they belong together."""
    source, dest = reader.source_fields(spark, source_text, names[0]), reader.dest_fields(spark, dest_text, names[1])
    verdict, pairings = pairing.assess_pair(source, dest)
    counts = source.groupBy("table").agg(F.count(F.lit(1)).alias("fields"))
    return {"source": source, "dest": dest, "assessment": verdict, "pairings": pairings, "table_counts": counts}


def candidates(source: DataFrame, dest: DataFrame, table: str, name: str, collection: str, top_k: int = DEFAULTS.top_k) -> DataFrame:
    """The shortlist of one column in one collection. Foreign keys score as if only this table were routed."""
    routing = source.sparkSession.createDataFrame([(table, collection)], "table string, collection string")
    limits = DEFAULTS.__class__(**{**DEFAULTS.__dict__, "top_k": top_k})
    return shortlist(source.filter((F.col("table") == table) & (F.col("name") == name)), dest, routing, limits=limits)


def run(spark: SparkSession, source_text: str, dest_text: str, batch: int = DEFAULTS.batch, top_k: int = DEFAULTS.top_k, **more) -> Run:
    """A whole run over two schema texts; batch 1 to 20, top_k 2 to 15, and whatever map_schemas() takes."""
    if not (1 <= batch <= 20 and 2 <= top_k <= 15):
        raise ValueError("batch is 1 to 20 and top_k 2 to 15")
    limits = DEFAULTS.__class__(**{**DEFAULTS.__dict__, "batch": batch, "top_k": top_k})
    return map_schemas(reader.source_fields(spark, source_text), reader.dest_fields(spark, dest_text), limits=limits, **more)


def runs(spark: SparkSession, folder: str, limit: int = HISTORY) -> DataFrame:
    """The newest runs that persist_run() kept in a folder: run_id, started_at, duration_ms, mapping, ok, calls."""
    return list_runs(spark, folder, limit)


def migrate_table(df: DataFrame, result: Run, table: str, keep: list[str] | None = None) -> DataFrame:
    """A whole table under a run's accepted mapping."""
    return migrate(df, compile_mapping(result.document, result.source, result.dest, table), keep)
