"""The mapping document, the explanations of what stays unmapped, and the run report's tables."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import mapping
from docweave.functions.text import ascii_arrows, band, first_sentence, needs_repair, plain_notes
from docweave.operators.decisions import table_confidence, with_dest
from docweave.types import DEFAULTS, Thresholds

VERSION = "1.0"


def now_iso() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _label(fields: DataFrame) -> Column:
    return F.concat(F.first("database"), F.lit(" ("), F.substring_index(F.first("dialect"), " ", 1), F.lit(")"))


def assemble(decisions: DataFrame, source: DataFrame, dest: DataFrame, routing: DataFrame, generated_at: str | None = None) -> DataFrame:
    """One row of MAPPING_DOCUMENT, tables and columns in order of declaration."""
    held = with_dest(decisions, dest).withColumn("ok", F.col("path").isNotNull() & F.col("legal"))
    rule = mapping.rule("p")
    entry = F.struct(
        F.col("name").alias("source_field"), F.col("path").alias("destination_field"), ascii_arrows(mapping.label("p", rule)).alias("type_transform"),
        F.round("confidence", 2).alias("confidence"), F.col("reasoning"), plain_notes(F.col("notes")).alias("notes"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("ord", entry.alias("e"))))), lambda x: x["e"])
    none = F.array().cast("array<string>")
    tables = held.groupBy("table", "table_ord", "collection").agg(
        ordered.alias("field_mappings"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name")))).alias("unmapped_source_fields"),
        F.collect_set(F.when(F.col("ok"), F.col("path"))).alias("targeted"), F.count_if("ok").alias("mapped"), F.count(F.lit(1)).alias("total"),
        F.avg(F.when(F.col("ok"), F.round("confidence", 2))).alias("mean"),
    )
    paths = dest.groupBy("collection").agg(F.collect_list("path").alias("paths"))
    default = F.concat(F.lit("Table "), "table", F.lit(" and collection "), "collection", F.lit(" share their field names' meaning."))
    reason = F.coalesce(F.when(F.trim("reasoning") != "", F.when(needs_repair(F.col("reasoning")), first_sentence(F.col("reasoning"))).otherwise(F.trim("reasoning"))), default)
    tables = tables.join(paths, "collection", "left").join(routing.select("table", "reasoning"), "table", "left")
    row = F.struct(
        F.col("table").alias("source_table"), F.col("collection").alias("destination_collection"), table_confidence(F.col("mean"), F.col("mapped"), F.col("total")).alias("confidence"),
        reason.alias("reasoning"), "field_mappings", "unmapped_source_fields",
        F.array_sort(F.array_except(F.coalesce("paths", none), "targeted")).alias("unmapped_destination_fields"),
    )
    whole = tables.agg(F.transform(F.array_sort(F.collect_list(F.struct("table_ord", row.alias("t")))), lambda x: x["t"]).alias("tables"))
    labels = source.agg(_label(source).alias("source")), dest.agg(_label(dest).alias("destination"))
    return (
        whole.crossJoin(labels[0]).crossJoin(labels[1])  # one row each
        .select(F.lit(VERSION).alias("mapping_version"), "source", "destination", F.lit(generated_at or now_iso()).alias("generated_at"), "tables")
    )


def to_json(document: DataFrame) -> DataFrame:
    """The document as JSON text; null notes are written."""
    return document.select(F.to_json(F.struct(*document.columns), {"ignoreNullFields": "false"}).alias("value"))


def unmapped_source(decisions: DataFrame) -> DataFrame:
    """table, name, reason of every unmapped column: what overruled it, else the adjudicator's reason, else a default."""
    reason = F.coalesce(
        F.when(F.trim("forced_null") != "", F.col("forced_null")), F.when(F.trim("reasoning") != "", F.col("reasoning")), F.lit("No candidate path means the same.")
    )
    return decisions.filter(F.col("path").isNull()).select("table", "name", F.trim(reason).alias("reason"))


def unmapped_destination(decisions: DataFrame, dest: DataFrame, routing: DataFrame) -> DataFrame:
    """collection, path, reason of every path without a column; a leaf beside a reference is a copy that a join fills."""
    parent = F.when(F.contains("path", F.lit(".")), F.regexp_replace("path", r"\.[^.]*$", "")).otherwise("")
    own = dest.join(F.broadcast(routing.select("table", "collection")), "collection").withColumn("parent", parent)
    refs = own.filter((F.col("bson_type") == "ObjectId") & (F.col("path") != "_id") & (F.col("parent") != ""))
    refs = refs.groupBy("table", "collection", "parent").agg(F.min_by(F.struct(F.col("path").alias("ref"), F.col("references").alias("to")), "ord").alias("r"))
    spare = own.join(decisions.filter(F.col("path").isNotNull()).select("table", "path"), ["table", "path"], "left_anti").join(refs, ["table", "collection", "parent"], "left")
    copy = F.concat(F.lit("A copy kept beside "), "r.ref", F.lit("; joining "), F.coalesce("r.to", F.lit("the referenced collection")), F.lit(" fills it, not a column of "), "table", F.lit("."))
    plain = F.concat(F.lit("No column of "), "table", F.lit(" means this path."))
    return spare.select("collection", "path", F.when(F.col("r").isNotNull() & (F.col("r.ref") != F.col("path")), copy).otherwise(plain).alias("reason"))


def mapped_fields(document: DataFrame) -> DataFrame:
    """A row per mapping of the document."""
    tables = document.select(F.explode("tables").alias("t"))
    return tables.select("t.source_table", "t.destination_collection", F.explode("t.field_mappings").alias("m")).select("source_table", "destination_collection", "m.*")


def quality(document: DataFrame, decisions: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """One row: counts per confidence band, mean confidence, and shares and counts of how decisions came about."""
    level = band(F.col("confidence"), limits.high, limits.medium)
    of_fields = mapped_fields(document).agg(
        *(F.count_if(level == b).alias(b) for b in ("high", "medium", "review")), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("mean_confidence")
    )
    late = F.col("decided_by").isin("escalated", "reflection")
    of_decisions = decisions.agg(
        F.round(F.count_if(late) / F.greatest(F.lit(1), F.count(F.lit(1))), 3).alias("escalation_rate"), F.count_if(F.col("decided_by") == "reflection").alias("reflections"),
        F.count_if("repaired").alias("repaired"), F.count_if("tie_broken").alias("tie_broken"),
    )
    return of_fields.crossJoin(of_decisions)  # one row each


def escalation(decisions: DataFrame) -> DataFrame:
    """One row: decisions that were escalated to the strong adjudicator, and their share of all."""
    taken = F.exists("passes", lambda p: p["pass"] == "escalated")
    return decisions.agg(F.count_if(taken).alias("escalated"), F.count(F.lit(1)).alias("decisions"), F.round(F.coalesce(F.avg(taken.cast("double")), F.lit(0.0)), 4).alias("stage3_escalation_rate"))


def coverage(document: DataFrame, source: DataFrame, dest: DataFrame) -> DataFrame:
    """One row: columns and paths in all, mapped, unmapped, accounted for. Paths count per collection."""
    own = mapped_fields(document).agg(F.count(F.lit(1)).alias("source_mapped"), F.count_distinct("destination_collection", "destination_field").alias("paths_targeted"))
    spare = document.select(F.explode("tables").alias("t")).agg(F.coalesce(F.sum(F.size("t.unmapped_source_fields")), F.lit(0)).alias("declared"))
    return (
        own.crossJoin(spare).crossJoin(source.agg(F.count(F.lit(1)).alias("source_total"))).crossJoin(dest.agg(F.count(F.lit(1)).alias("paths_total")))  # one row each
        .select("source_total", "source_mapped", (F.col("source_total") - F.col("source_mapped")).alias("source_unmapped"), "paths_total", "paths_targeted",
                (F.col("source_mapped") + F.col("declared")).alias("accounted"))
    )


def shortlist_stats(questions: DataFrame) -> DataFrame:
    """One row over open decisions: columns, candidates offered, average."""
    n = F.sum(F.size("candidates"))
    return questions.agg(F.count(F.lit(1)).alias("fields"), n.alias("offered"), F.round(n / F.greatest(F.lit(1), F.count(F.lit(1))), 2).alias("average"))


def review_list(document: DataFrame, below: float | None = DEFAULTS.medium) -> DataFrame:
    """Mappings with their band, least sure last; ``below``: only those that need review."""
    rows = mapped_fields(document).withColumn("band", band(F.col("confidence")))
    return (rows if below is None else rows.filter(F.col("confidence") < below)).orderBy(F.desc("confidence"), "source_table", "source_field")


def mapped_first(source: DataFrame, document: DataFrame) -> DataFrame:
    """Columns of each table for display: mapped ones first, each kind in order of declaration; with their path."""
    found = mapped_fields(document).select(F.col("source_table").alias("table"), F.col("source_field").alias("name"), F.col("destination_field").alias("path"))
    rows = source.select("table", "table_ord", "ord", "name").join(found, ["table", "name"], "left")
    return rows.orderBy("table_ord", F.col("path").isNull(), "ord").select("table", "name", "path")


def paths_following(dest: DataFrame, source: DataFrame, document: DataFrame) -> DataFrame:
    """Paths of each collection for display: in the order of the columns that fill them, then the others as declared."""
    found = mapped_fields(document).join(
        source.select(F.col("table").alias("source_table"), F.col("name").alias("source_field"), F.col("ord").alias("at")), ["source_table", "source_field"]
    )
    found = found.select(F.col("destination_collection").alias("collection"), F.col("destination_field").alias("path"), "at")
    rows = dest.select("collection", "coll_ord", "ord", "path").join(found, ["collection", "path"], "left")
    return rows.orderBy("coll_ord", F.col("at").isNull(), "at", "ord").select("collection", "path", (F.col("at").isNotNull()).alias("mapped"))
